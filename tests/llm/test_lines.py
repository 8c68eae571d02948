import hashlib

from gainsieve.llm.lines import cleaned, line_report

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, line string"


def rows():
    out = []
    for i in range(12):
        common = "\n".join([" Menu | Home ", f"Unique {i}.", "shared by nine" if i < 9 else "other", "shared by ten" if i < 10 else "more", ""])
        out.append((i, common, "en", f"s{i}", len(common), "x", "y"))
    out += [(20, "one site only\n" * 30, "en", "s0", 0, "x", "y"), (21, None, "en", "s1", None, "x", "y"), (22, "", None, None, 0, "x", "y"), (23, "shared by nine", "en", None, 14, "x", "y")]
    out += [(0, out[0][1], "en", "s0", 9, "x", "y"), (None, "Menu | Home\nrest", "en", "s3", 16, None, None), (24, "z\n" * 100_000 + "Menu | Home", "en", "s1", 200_011, "x", "y")]
    return out


def test_lines_on_ten_sites_go(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    sites = {}
    for _, text, _, site, *_ in data:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None:
                sites.setdefault(line.strip(" "), set()).add(site)
    bad = {line for line, s in sites.items() if len(s) >= 10}
    assert bad == {"Menu | Home", "shared by ten"}
    keep = lambda t: "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad)
    want = sorted((str(d[0]), 0 if d[1] is None else d[1].count("\n") + 1, hashlib.sha256(keep(d[1] or "").encode()).hexdigest()) for d in data)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["kept_sha256"]) for r in line_report(df).collect()) == want
    out = cleaned(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect() if r["text"] is not None) == sorted((str(d[0]), keep(d[1])) for d in data if d[1] is not None)
    assert {r["doc_id"]: r["n_chars"] for r in out.collect()}[3] == len(keep(data[3][1]))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert line_report(df).count() == cleaned(df).count() == 0


def test_columns_with_the_names_of_helpers_stay(spark):
    names = ["_k1", "_k2", "_remove", "_n_lines", "_n_removed", "_line_dedup", "_LINE_dedup_key", "at", "key", "h1", "n_removed", "a.b"]
    df = spark.createDataFrame([(i, "both\n" + str(i), f"s{i}", *range(i, i + len(names))) for i in range(11)], ["doc_id", "text", "source", *names])
    got = cleaned(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(i, str(i), f"s{i}", *range(i, i + len(names))) for i in range(11)]
