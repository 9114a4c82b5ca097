"""The SQL side of the vector queries: the same definitions in list functions, as common table expressions."""

from __future__ import annotations

from vektora.operators.schemes import Scheme

DIM = 64
#: Searching rows are those whose id is divisible by this, against all rows.
EVERY = 50

VEC = "vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
TAILS = "tails AS (SELECT vec_id, label, v, list_transform(range(1, len(v) + 1), lambda i: sqrt(list_sum(list_transform(v[i:], lambda x: x * x)))) AS s FROM vec)"
ANGLES = """ang AS (SELECT vec_id, label, v, list_transform(range(1, len(v)), lambda i: CASE
  WHEN i < len(v) - 1 THEN acos(greatest(-1.0, least(1.0, v[i] / greatest(s[i], 1e-7))))
  WHEN atan2(v[i + 1], v[i]) < 0 THEN atan2(v[i + 1], v[i]) + 2 * pi() ELSE atan2(v[i + 1], v[i]) END) AS a FROM tails)"""
LONG = """lng AS (SELECT vec_id, i - 1 AS pos, a[i] AS angle FROM (SELECT vec_id, a, unnest(range(1, len(a) + 1)) AS i FROM ang)),
cum AS (SELECT vec_id, pos, angle, coalesce(sum(2 * ln(greatest(abs(sin(angle)), 1e-7))) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM lng)"""
STATS = """base AS (SELECT pos, avg(angle) AS mean_angle, stddev_pop(angle) AS std_angle, avg(cum) AS m FROM cum GROUP BY pos),
sens AS (SELECT pos, mean_angle, std_angle, exp(m - max(m) OVER ()) AS sens FROM base),
stats AS (SELECT *, row_number() OVER (ORDER BY round(sens, 12) DESC, pos) - 1 AS rank FROM sens),
arr AS (SELECT list(mean_angle ORDER BY pos) AS means, list(rank ORDER BY pos) AS ranks, list(sens ORDER BY pos) AS sens FROM stats)"""
UPTO_STATS = ",\n".join((VEC, TAILS, ANGLES, LONG, STATS))
UPTO_ANGLES = ",\n".join((VEC, TAILS, ANGLES))


def top(i: str = "i") -> str:
    return f"CASE WHEN {i} = {DIM - 1} THEN 2 * pi() ELSE pi() END"


def code(t: str, bits: int | str, i: str = "i") -> str:
    """Bin of angle t at position i (from 1)."""
    n = f"(2.0 ** {bits})"
    return f"greatest(0, least({n} - 1, floor(greatest(0, least({t}, {top(i)} - 1e-6)) / ({top(i)}) * {n})))"


def middle(t: str, bits: int | str, i: str = "i") -> str:
    return f"(({code(t, bits, i)} + 0.5) * ({top(i)}) / (2.0 ** {bits}))"


def unit(x: str, eps: str = "1e-7") -> str:
    return f"list_transform({x}, lambda e: e / greatest(sqrt(list_sum(list_transform({x}, lambda y: y * y))), {eps}))"


def from_angles(c: str) -> str:
    return f"""list_transform(range(1, len({c}) + 2), lambda i: coalesce(list_aggregate(list_transform({c}[1:i - 1], lambda t: sin(t)), 'product'), 1.0) * CASE WHEN i <= len({c}) THEN cos({c}[i]) ELSE 1.0 END)"""


def shifted(v: str, bits: int) -> str:
    s = (2**bits - 1) / 2
    return f"list_transform({v}, lambda x: greatest(0, least({2**bits - 1}, round_even(greatest(-1.0, least(1.0, x)) * {s} + {s / 2}, 0))))"


def shifted_values(v: str, bits: int) -> str:
    s = (2**bits - 1) / 2
    return f"list_transform({shifted(v, bits)}, lambda q: (q + 0.5) / {s} - 1)"


#: What each step of the tiers gains, relative to the range's square / 12.
LADDER = "(VALUES (0, 2, 1.0 - 1.0 / 16), (2, 4, 1.0 / 16 - 1.0 / 256), (4, 8, 1.0 / 256 - 1.0 / 65536), (8, 16, 1.0 / 65536 - 2.0 ** -20), (16, 32, 2.0 ** -20 - 2.0 ** -46)) l(lo, hi, gain)"


def tiers_walk(budgets) -> str:
    """tiers (budget, w): the tiers' bits after walking down the list of all steps, each taken if it is its angle's next and fits.

    Needs stats, and WITH RECURSIVE."""
    n = DIM - 1
    given = ", ".join(f"({b})" for b in budgets)
    return f"""steps AS (SELECT pos, lo, hi, hi - lo AS cost, sens * ({top('pos + 1')}) ** 2 / 12 * gain / (hi - lo) AS worth FROM stats, {LADDER}),
listed AS (SELECT *, row_number() OVER (ORDER BY worth DESC, pos, lo) AS r FROM steps WHERE worth > 0),
walk AS (SELECT 0 AS r, b AS budget, b AS spare, list_transform(range({n}), lambda x: 0) AS w FROM (VALUES {given}) t(b)
UNION ALL SELECT x.r + 1, budget, CASE WHEN w[pos + 1] = lo AND cost <= spare THEN spare - cost ELSE spare END,
  CASE WHEN w[pos + 1] = lo AND cost <= spare THEN list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = pos + 1 THEN hi ELSE w[i] END) ELSE w END FROM walk x JOIN listed l ON l.r = x.r + 1),
tiers AS (SELECT budget, w FROM walk WHERE r = (SELECT max(r) FROM listed))"""


def decoded_tiers(w: str = "w") -> str:
    """Angles a after the tiers of list w, means in scope."""
    bins = " ".join(f"WHEN {w}[i] = {b} THEN {middle('a[i]', b)}" for b in (2, 4, 8))
    return f"list_transform(range(1, {DIM}), lambda i: CASE WHEN {w}[i] = 0 THEN means[i] {bins} WHEN {w}[i] = 16 THEN {half('a[i]')} ELSE a[i] END)"


def union_tiers() -> str:
    """SELECT scheme, vec_id, r of every budget's tiers."""
    return f"SELECT 'greedy_' || budget || 'b' AS scheme, vec_id, {unit('x')} AS r FROM (SELECT budget, vec_id, {from_angles('c')} AS x FROM (SELECT budget, vec_id, {decoded_tiers()} AS c FROM ang, arr, tiers))"


def proportional(share: str, budget: int, high: int = 16) -> str:
    """widths (pos, bits) from a query of (pos, share): whole bits first, then single steps, the farthest from their share first."""
    return f"""share AS ({share}), whole AS (SELECT pos, share, CAST(least({high}, greatest(0, floor(share))) AS INTEGER) AS b FROM share),
lack AS (SELECT {budget} - sum(b) AS short FROM whole),
moves AS (SELECT pos, 1 AS d, round(lv - share, 12) AS far FROM (SELECT pos, share, unnest(range(b, {high})) AS lv FROM whole), lack WHERE short > 0
  UNION ALL SELECT pos, -1, round(share - lv, 12) FROM (SELECT pos, share, unnest(range(1, b + 1)) AS lv FROM whole), lack WHERE short < 0),
taken AS (SELECT pos, d FROM moves, lack QUALIFY row_number() OVER (ORDER BY far, pos) <= abs(short)),
widths AS (SELECT whole.pos, CAST(any_value(b) + coalesce(sum(d), 0) AS INTEGER) AS bits FROM whole LEFT JOIN taken USING (pos) GROUP BY 1)"""


def half(x: str) -> str:
    step = f"(2.0 ** (greatest(floor(log2(CASE WHEN {x} = 0 THEN 1 ELSE abs({x}) END)), -14) - 10))"
    return f"(round_even({x} / {step}, 0) * {step})"


def decoded_angles(s: Scheme) -> str:
    """Angles of ang (column a), after the scheme, with arr in scope."""
    if s.family == "tiers":
        return decoded_tiers("[" + ", ".join(map(str, s.tiers)) + "]")
    if s.keep is None:
        return f"list_transform(range(1, {DIM}), lambda i: {middle('a[i]', s.bits)})"
    kept = f"ranks[i] < {s.keep}" if s.by == "rank" else f"i <= {s.keep}"
    return f"list_transform(range(1, {DIM}), lambda i: CASE WHEN {kept} THEN {middle('a[i]', s.bits)} ELSE {'means[i]' if s.fill == 'mean' else '0.0'} END)"


def decoded(s: Scheme) -> str:
    """SELECT vec_id, r: the reconstructed vectors of a scheme (vec, ang and arr in scope)."""
    if s.family == "float":
        return "SELECT vec_id, v AS r FROM vec"
    if s.family == "cartesian":
        return f"SELECT vec_id, {unit('x')} AS r FROM (SELECT vec_id, {shifted_values('v', s.bits)} AS x FROM vec)"
    if s.family == "truncated":
        head = f"v[1:{s.keep}]" if s.bits >= 32 else shifted_values(f"v[1:{s.keep}]", s.bits)
        zeros = "[" + ", ".join(["0.0"] * (DIM - s.keep)) + "]"
        return f"SELECT vec_id, {unit('x')} AS r FROM (SELECT vec_id, list_concat({head}, CAST({zeros} AS DOUBLE[])) AS x FROM vec)"
    return f"SELECT vec_id, {unit('x')} AS r FROM (SELECT vec_id, {from_angles('c')} AS x FROM (SELECT vec_id, {decoded_angles(s)} AS c FROM ang, arr))"


def union_decoded(schemes: list[Scheme]) -> str:
    return "dec AS (" + " UNION ALL ".join(f"SELECT '{s.name}' AS scheme, vec_id, r FROM ({decoded(s)})" for s in schemes) + ")"


QUERIES = f"qry AS (SELECT vec_id AS query_id, v AS qv FROM vec WHERE vec_id % {EVERY} = 0)"


def ranked(k: int, docs: str = "dec", queries: str = "qry", on: str = "true") -> str:
    return f"""(SELECT scheme, query_id, doc_id, score, rank FROM (SELECT scheme, query_id, doc_id, score, row_number() OVER (PARTITION BY scheme, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM (SELECT d.scheme, q.query_id, d.vec_id AS doc_id, list_dot_product(q.qv, d.r) AS score FROM {docs} d JOIN {queries} q ON {on})) WHERE rank <= {k})"""


FLOATS = "flt AS (SELECT 'float32' AS scheme, vec_id, v AS r FROM vec)"
#: The ten best exact matches are relevant: grade 3 for the first two, 2 up to the fifth, 1 up to the tenth.
EXACT = f"exact AS (SELECT query_id, doc_id AS corpus_id, CASE WHEN rank <= 2 THEN 3 WHEN rank <= 5 THEN 2 ELSE 1 END AS score FROM {ranked(10, 'flt')})"


def quality(ranking: str = "rnk", by: str = "scheme") -> str:
    """per-query metrics of a ranking against `exact`."""
    ks = (5, 10, 15, 20)
    idcg = ", ".join(f"sum(CASE WHEN place <= {k} THEN score / log2(place + 1) END) AS idcg{k}" for k in ks)
    dcg = ", ".join(f"coalesce(sum(CASE WHEN rank <= {k} THEN e.score / log2(rank + 1) END), 0) AS dcg{k}" for k in ks)
    nd = ", ".join(f"dcg{k} / idcg{k} AS ndcg{k}" for k in ks)
    return f"""ideal AS (SELECT query_id, count(*) AS relevant, {idcg} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS place FROM exact) GROUP BY 1),
perq AS (SELECT {by}, query_id, {nd}, found / relevant AS recall100 FROM (SELECT {by}, r.query_id, {dcg}, count(e.score) AS found FROM {ranking} r
  LEFT JOIN exact e ON e.query_id = r.query_id AND e.corpus_id = r.doc_id GROUP BY ALL) JOIN ideal USING (query_id))"""
