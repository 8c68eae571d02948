"""Check SQL of a whole fit, as one chain of common table expressions.

It works row by row with lists of row ids, quite unlike the library, so that the
two can disagree.
"""

from __future__ import annotations

import re

from catalog.views import View
from gainsieve.operators.mine import default_fs_k, default_top_k

RANK = "CAST(least(ceil(CAST(CAST(q * 100.0::DOUBLE / {nb} AS FLOAT) AS DOUBLE) / 100.0::DOUBLE * (n - 1)), n - 1) AS BIGINT) + 1"


def xlog(p: str, log: str = "ln") -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * {log}({p}) ELSE 0 END"


def edge_list(nb: str) -> str:
    at = RANK.format(nb=nb)
    return f"list_sort(list_distinct(list_transform(range(0, {nb} + 1), lambda q: vs[{at}])))"


def bin_of(es: str = "es", v: str = "v") -> str:
    k = f"len(list_filter({es}, lambda x: x <= {v}))"
    return f"CASE WHEN {k} BETWEEN 1 AND len({es}) - 1 THEN {k} ELSE len({es}) END"


def encode_ctes(view: View, bins: int) -> list[str]:
    numeric = [*view.ints, *view.floats]
    num = " UNION ALL ".join(
        f"SELECT tid, y, {i} AS ci, '{c}' AS col, '{'int' if i < len(view.ints) else 'float'}' AS kind, {c}::DOUBLE AS v FROM d"
        for i, c in enumerate(numeric)
    )
    ctes = [
        f"src AS ({view.sql()})",
        "codes AS (SELECT lab, (row_number() OVER (ORDER BY count(*) DESC, lab) - 1)::INTEGER AS y, count(*) AS ny"
        " FROM src GROUP BY lab)",
        "d AS (SELECT src.*, y FROM src JOIN codes USING (lab))",
        "tot AS (SELECT sum(ny)::DOUBLE AS n, sum(y * ny)::DOUBLE AS sy, sum(y * y * ny)::DOUBLE AS syy, count(*) AS k FROM codes)",
        f"num AS ({num})",
        "rng AS (SELECT ci, col, kind, min(v) AS mn, max(v) AS mx, count(DISTINCT v) AS nd, count(*) AS n FROM num GROUP BY ALL)",
        "srt AS (SELECT ci, list(v ORDER BY v) AS vs FROM num GROUP BY ci)",
    ]
    if bins == -1:
        ctes += [
            f"cand AS (SELECT ci, nb, {edge_list('nb')} AS es FROM rng JOIN srt USING (ci),"
            " (SELECT unnest(range(2, 21)) AS nb))",
            f"cbin AS (SELECT ci, nb, y, {bin_of()} AS bin FROM num JOIN cand USING (ci))",
            "ccnt AS (SELECT ci, nb, bin, y, count(*) AS c FROM cbin GROUP BY ALL)",
            "cent AS (SELECT ci, nb, bin, sum(c) AS m, -sum(c / m2 * ln(c / m2)) / ln(any_value(k)) AS h FROM"
            " (SELECT *, sum(c) OVER (PARTITION BY ci, nb, bin) AS m2 FROM ccnt), tot GROUP BY ci, nb, bin)",
            "base AS (SELECT -sum(ny / n * ln(ny / n)) / ln(any_value(k)) AS h0 FROM codes, tot)",
            "gains AS (SELECT ci, nb, floor((any_value(h0) - sum(m / n * h)) * 1e6 + 0.5) / 1e6 AS gain"
            " FROM cent, tot, base GROUP BY ci, nb)",
            "best AS (SELECT ci, coalesce(min(nb) FILTER (gain = g AND gain > 0), 2) AS bb FROM"
            " (SELECT *, max(gain) OVER (PARTITION BY ci) AS g FROM gains) GROUP BY ci)",
            "nbs AS (SELECT rng.*, greatest(least(nd - 1, bb), 2) AS nb FROM rng JOIN best USING (ci))",
        ]
    else:
        ctes.append(f"nbs AS (SELECT *, greatest(least(nd - 1, {bins}), 2) AS nb FROM rng)")
    ctes += [
        f"edges AS (SELECT ci, col, kind, mn, mx, {edge_list('nb')} AS es FROM nbs JOIN srt USING (ci) WHERE nd > 1)",
        f"binned AS (SELECT tid, y, ci, {bin_of()} AS bin FROM num JOIN edges USING (ci))",
    ]
    return ctes


def score_ctes(view: View) -> list[str]:
    n_numeric = len(view.ints) + len(view.floats)
    cat = " UNION ALL ".join(
        f"SELECT tid, y, {n_numeric + j} AS ci, '{c}' AS col, trim({c}) AS label FROM d" for j, c in enumerate(view.cats)
    )
    if not view.cats:
        cat = "SELECT tid, y, -1 AS ci, '' AS col, '' AS label FROM d WHERE false"
    corr = (
        "CASE WHEN sxx - sx * sx / n > 0 AND syy - sy * sy / n > 0"
        " THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) ELSE 0 END"
    )
    up = (
        "CASE WHEN kind = 'int' THEN CASE WHEN es[len(es)] = 0 THEN 0 ELSE es[{b}] / es[len(es)] END"
        " ELSE ((es[{b}] - mn) / (mx - mn)) / ((es[len(es)] - mn) / (mx - mn)) END"
    )
    return [
        f"corrs AS (SELECT ci, floor({corr} * 1e6 + 0.5) / 1e6 AS r FROM (SELECT ci, sum(bin)::DOUBLE AS sx,"
        " sum(bin * bin)::DOUBLE AS sxx, sum(bin * y)::DOUBLE AS sxy FROM binned GROUP BY ci), tot)",
        f"grid AS (SELECT ci, col, bin, es[bin] AS lo, es[bin + 1] AS hi, r,"
        f" CASE WHEN r > 0 THEN {up.format(b='bin + 1')} ELSE {up.format(b='len(es) + 1 - bin')} END AS internal"
        " FROM (SELECT *, unnest(range(1, len(es))) AS bin FROM edges) JOIN corrs USING (ci))",
        f"cat AS ({cat})",
        "lab AS (SELECT ci, col, label, row_number() OVER (PARTITION BY ci ORDER BY label) AS bin, count(*) AS nx,"
        " sum(y)::DOUBLE AS sxy FROM cat GROUP BY ci, col, label)",
        "cell AS (SELECT l.ci, l.label, codes.y, codes.ny, coalesce(c, 0) AS c FROM lab l CROSS JOIN codes LEFT JOIN"
        " (SELECT ci, label, y, count(*) AS c FROM cat GROUP BY ALL) x ON x.ci = l.ci AND x.label = l.label AND x.y = codes.y)",
        f"ent AS (SELECT ci, label, -sum({xlog('(c / n)', 'log2')} + {xlog('((ny - c) / n)', 'log2')}) AS hxy,"
        f" -sum({xlog('(ny / n)', 'log2')}) AS hy FROM cell, tot GROUP BY ci, label)",
        f"assoc AS (SELECT ci, col, label, bin, floor({corr} * 1e6 + 0.5) / 1e6 AS r,"
        " floor(CASE WHEN hx * hy > 0 THEN (hx + hy - hxy) / sqrt(hx * hy) ELSE 0 END * 1e6 + 0.5) / 1e6 AS nmi FROM"
        f" (SELECT lab.*, nx::DOUBLE AS sx, nx::DOUBLE AS sxx, hxy, hy, n, sy, syy,"
        f" -({xlog('(nx / n)', 'log2')} + {xlog('((n - nx) / n)', 'log2')}) AS hx FROM lab JOIN ent USING (ci, label), tot))",
        "scored AS (SELECT ci, col, bin, NULL AS label, lo, hi, r, abs(r) AS external, internal,"
        " col || '=[' || lo::VARCHAR || '-' || hi::VARCHAR || ']' AS name FROM grid UNION ALL"
        " SELECT ci, col, bin, label, NULL, NULL, r, nmi, CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END,"
        " col || '=' || label FROM assoc)",
        "items AS (SELECT *, row_number() OVER (ORDER BY ci, bin)::INTEGER AS item,"
        " floor(external * internal / (SELECT max(external * internal) FROM scored) * 1e6 + 0.5)::BIGINT AS u"
        " FROM scored WHERE external * internal > 0)",
        "tx AS (SELECT tid, y, item, u FROM binned JOIN items USING (ci, bin) WHERE items.label IS NULL UNION ALL"
        " SELECT tid, y, item, u FROM cat JOIN items ON cat.ci = items.ci AND cat.label = items.label)",
        "tus AS (SELECT tid, sum(u) AS tu FROM tx GROUP BY tid)",
    ]


def _gain(parent: str) -> str:
    """Gain, entropy and pure class from (c, p) per class: c rows with the set, p rows of the parent."""
    return (
        f"-sum({xlog('(c / n1)')}) AS entropy,"
        " CASE WHEN max(c) = any_value(n1) THEN arg_max(y, c) ELSE -1 END AS pure_class,"
        f" CASE WHEN any_value(np) > any_value(n1) THEN round(-sum({xlog('(p / np)')})"
        f" + any_value(n1 / np) * sum({xlog('(c / n1)')})"
        f" + any_value((np - n1) / np) * sum(CASE WHEN p > c THEN (p - c) / (np - n1) * ln((p - c) / (np - n1)) ELSE 0 END), 12) END AS ig"
    )


def _stats(name: str, occ: str, keys: list[str], parent: str | None, parent_key: str | None = None) -> list[str]:
    """Statistics of itemsets listed row by row in ``occ`` (keys, tid, y, w = utility of the row's set)."""
    k = ", ".join(keys)
    on = " AND ".join(f"x.{c} = s.{c}" for c in keys)
    size = "p.ny" if parent is None else "coalesce(p.c, 0)"
    source = (
        "JOIN codes p ON true"
        if parent is None
        else f"JOIN (SELECT a.rk, codes.y, coalesce(b.c, 0) AS c FROM (SELECT DISTINCT rk FROM {parent}) a CROSS JOIN codes"
        f" LEFT JOIN (SELECT rk, y, count(*) AS c FROM {parent} GROUP BY ALL) b ON a.rk = b.rk AND b.y = codes.y) p"
        f" ON p.rk = s.{parent_key}"
    )
    return [
        f"{name}_s AS (SELECT {k}, count(*) AS support, sum(w)::HUGEINT AS util, list(tid ORDER BY tid) AS tids FROM {occ} GROUP BY {k})",
        f"{name}_c AS (SELECT {k}, y, count(*) AS c FROM {occ} GROUP BY {k}, y)",
        f"{name}_p AS (SELECT {', '.join('s.' + c for c in keys)}, p.y, {size} AS p, coalesce(x.c, 0) AS c, s.support::DOUBLE AS n1,"
        f" (sum({size}) OVER (PARTITION BY {', '.join('s.' + c for c in keys)}))::DOUBLE AS np"
        f" FROM {name}_s s {source} LEFT JOIN {name}_c x ON {on} AND x.y = p.y)",
        f"{name}_g AS (SELECT {k}, {_gain('')} FROM {name}_p GROUP BY {k})",
        f"{name} AS (SELECT * FROM {name}_s JOIN {name}_g USING ({k}))",
    ]


def mine_ctes(length: int, gain: float, top_k: int, fs_k: int, keep: str = "lowest") -> list[str]:
    g = repr(float(gain)) + "::DOUBLE"
    ctes = [
        "sums AS (SELECT item, count(*) AS support, sum(tu)::HUGEINT AS twu, sum(u)::HUGEINT AS riu"
        " FROM tx JOIN tus USING (tid) GROUP BY item)",
        f"t0 AS (SELECT CASE WHEN count(*) >= {top_k} THEN (SELECT riu FROM sums ORDER BY riu DESC LIMIT 1 OFFSET {top_k - 1})"
        " ELSE 0 END AS t FROM sums)",
        "ranked AS (SELECT items.*, support, twu, riu, row_number() OVER (ORDER BY twu, item)::INTEGER AS rk"
        " FROM items JOIN sums USING (item), t0 WHERE twu >= t)",
        "rtx AS (SELECT tid, y, rk, tx.u AS w FROM tx JOIN ranked USING (item))",
        *_stats("l1", "rtx", ["rk"], None),
    ]
    emitted = ["SELECT [rk] AS ranks, support, util, ig, entropy, pure_class, tids FROM l1, t1 WHERE ig > {g} AND util >= t AND util > 0"]
    if length >= 2:
        ctes += [
            "occ2 AS (SELECT a.rk AS x, b.rk AS z, a.tid, a.y, a.w + b.w AS w FROM rtx a JOIN rtx b ON a.tid = b.tid AND a.rk < b.rk)",
            *_stats("pr", "occ2", ["x", "z"], None),
            f"t1 AS (SELECT greatest(t, CASE WHEN (SELECT count(*) FROM pr WHERE util >= t) >= {top_k}"
            f" THEN (SELECT util FROM pr WHERE util >= t ORDER BY util DESC LIMIT 1 OFFSET {top_k - 1}) ELSE 0 END) AS t FROM t0)",
            f"ok1 AS (SELECT rk FROM l1 WHERE ig > {g})",
            f"l2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x, tids ORDER BY z) AS dup FROM pr"
            f" WHERE ig > {g} AND x IN (FROM ok1) AND z IN (FROM ok1)) WHERE dup = 1)",
        ]
        emitted.append("SELECT [x, z], support, util, ig, entropy, pure_class, tids FROM l2, t1 WHERE util >= t AND util > 0")
    else:
        ctes.append("t1 AS (SELECT t FROM t0)")
    if length >= 3:
        ctes += [
            "occ3 AS (SELECT a.x, a.z, b.z AS v, r1.tid, r1.y, r1.w + r2.w + r3.w AS w FROM l2 a JOIN l2 b ON a.x = b.x AND a.z < b.z"
            " JOIN rtx r1 ON r1.rk = a.x JOIN rtx r2 ON r2.rk = a.z AND r2.tid = r1.tid JOIN rtx r3 ON r3.rk = b.z AND r3.tid = r1.tid)",
            *_stats("tr", "occ3", ["x", "z", "v"], "rtx", "x"),
            f"l3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x, z, tids ORDER BY v) AS dup FROM tr WHERE ig > {g}) WHERE dup = 1)",
        ]
        emitted.append("SELECT [x, z, v], support, util, ig, entropy, pure_class, tids FROM l3, t1 WHERE util >= t AND util > 0")
    limit = f"LIMIT {fs_k}" if fs_k != -1 else ""
    order = "ig, util, items DESC" if keep == "lowest" else "ig DESC, util DESC, items"
    ctes += [
        "found0 AS (" + " UNION ALL ".join(emitted).replace("{g}", g) + ")",
        "found AS (SELECT f.*, i.items, i.names FROM found0 f JOIN (SELECT ranks, list(item ORDER BY pos) AS items,"
        " list(name ORDER BY pos) AS names FROM (SELECT ranks, unnest(ranks) AS rk, generate_subscripts(ranks, 1) AS pos FROM found0)"
        " JOIN ranked USING (rk) GROUP BY ranks) i USING (ranks))",
        f"topk AS (SELECT * FROM found ORDER BY util DESC, items LIMIT {top_k})",
        f"uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tids ORDER BY {order}) AS dup FROM topk) WHERE dup = 1)",
        "patterns AS (SELECT *, (row_number() OVER (ORDER BY ig DESC, util DESC, items) - 1)::INTEGER AS pid FROM uniq"
        f" ORDER BY pid {limit})",
    ]
    return ctes


def weighted_ctes(view: View, bins: int, weights: list[int]) -> list[str]:
    """The encoded rows, each as often as the weight of its class says, under numbers of its own."""
    plain = [re.sub(r"\b(codes|d|tot|binned)\b", r"\1_once", c) for c in encode_ctes(view, bins)]
    copies = f"(SELECT unnest(range({weights}[r.y + 1])) AS i)"
    return [
        *plain,
        f"codes AS (SELECT lab, y, ny * {weights}[y + 1] AS ny FROM codes_once)",
        "tot AS (SELECT sum(ny)::DOUBLE AS n, sum(y * ny)::DOUBLE AS sy, sum(y * y * ny)::DOUBLE AS syy, count(*) AS k FROM codes)",
        f"d AS (SELECT r.* REPLACE (r.tid * {max(weights)} + i AS tid) FROM d_once r, LATERAL {copies})",
        f"binned AS (SELECT r.* REPLACE (r.tid * {max(weights)} + i AS tid) FROM binned_once r, LATERAL {copies})",
    ]


def fit_sql(view: View, final: str, bins: int = 5, length: int = 1, gain: float = 1e-4, top_k: int = -1, fs_k: int = -1,
            keep: str = "lowest", extra: list[str] | None = None, weights: list[int] | None = None) -> str:
    top_k = default_top_k(length, top_k, 1.0)
    encoded = weighted_ctes(view, bins, weights) if weights else encode_ctes(view, bins)
    ctes = encoded + score_ctes(view) + mine_ctes(length, gain, top_k, default_fs_k(fs_k, top_k), keep)
    return "WITH " + ",\n".join([*ctes, *(extra or [])]) + "\n" + final


def apply_ctes(view: View, unseen: str) -> list[str]:
    """Items and contained patterns of the rows of an unseen source (tid and the features)."""
    n_numeric = len(view.ints) + len(view.floats)
    num = " UNION ALL ".join(
        f"SELECT tid, {i} AS ci, {c}::DOUBLE AS v FROM un" for i, c in enumerate([*view.ints, *view.floats])
    )
    cat = " UNION ALL ".join(f"SELECT tid, {n_numeric + j} AS ci, trim({c}) AS label FROM un" for j, c in enumerate(view.cats))
    return [
        f"un AS ({unseen})",
        f"unbin AS (SELECT tid, ci, {bin_of()} AS bin FROM ({num}) JOIN edges USING (ci))",
        f"untx AS (SELECT tid, item FROM unbin JOIN items USING (ci, bin) WHERE items.label IS NULL UNION ALL"
        f" SELECT tid, item FROM ({cat}) x JOIN items ON x.ci = items.ci AND x.label = items.label)",
    ]


COVER = (
    "cover AS (SELECT tid, pid FROM (SELECT pid, unnest(items) AS item, len(items) AS size FROM patterns) JOIN untx USING (item)"
    " GROUP BY tid, pid, size HAVING count(*) = size)"
)


def encode_sql(view: View, final: str, bins: int = 5, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join([*encode_ctes(view, bins), *(extra or [])]) + "\n" + final


def score_sql(view: View, final: str, bins: int = 5, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join([*encode_ctes(view, bins), *score_ctes(view), *(extra or [])]) + "\n" + final
