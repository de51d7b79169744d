"""SQL text for the DuckDB cross-check of the registered queries.

Plain SQL over the driver's tables, written from the definitions (not from
the Spark plans): dense-style formulas restricted to non-zero pairs, DBSCAN
with a recursive CTE for connected components, and a ladder of layers as a
chain of CTEs.  Every double is rounded to 6 decimals in outputs and every
distance to 12 decimals before comparing with a radius, as in the engine.
"""

from __future__ import annotations

from collections.abc import Sequence


def dbl(x: float) -> str:
    """A float literal that DuckDB reads as exactly the same double."""
    return f"CAST('{x!r}' AS DOUBLE)"


def dist(sim: str) -> str:
    return f"round(greatest(0.0, 1.0 - {sim}), 12)"


# --- inputs ---------------------------------------------------------------------------------

def word_counts(table: str, key: str, text: str) -> str:
    return (
        f"SELECT CAST({key} AS BIGINT) AS idx, term, count(*) AS n FROM ("
        f"SELECT {key}, unnest(regexp_extract_all(lower({text}), '([a-z]+)', 1)) AS term FROM {table}"
        f") GROUP BY ALL"
    )


def tfidf(wc: str) -> str:
    return (
        f"SELECT w.idx, w.term, w.n * (ln((1.0 + nd.n_docs) / (1.0 + d.df)) + 1.0) AS x "
        f"FROM ({wc}) w JOIN (SELECT term, count(*) AS df FROM ({wc}) GROUP BY term) d USING (term) "
        f"CROSS JOIN (SELECT count(DISTINCT idx) AS n_docs FROM ({wc})) nd"
    )


def trace_edges(table: str, trace: str, order: Sequence[str], atom: str, cast: str | None = "BIGINT") -> str:
    a = f"CAST({atom} AS {cast})" if cast else atom
    return (
        f"SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM ("
        f"SELECT {a} AS src, lead({a}) OVER (PARTITION BY {trace} ORDER BY {', '.join(order)}) AS dst "
        f"FROM {table} WHERE {atom} IS NOT NULL) WHERE dst IS NOT NULL GROUP BY src, dst"
    )


ORDER_ADJACENCY = trace_edges("lineitem", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")

CUSTOMER_SEQUENCE = trace_edges(
    "(SELECT o.o_custkey, o.o_orderdate, o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey "
    "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)",
    "o_custkey",
    ["o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    "l_partkey",
)

TRADE_EDGES = (
    "SELECT CAST(s.s_nationkey AS BIGINT) AS src, CAST(c.c_nationkey AS BIGINT) AS dst, "
    "CAST(count(*) AS DOUBLE) AS w "
    "FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey "
    "JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL"
)

CUSTOMER_BRAND_EDGES = (
    "SELECT o.o_custkey AS src, b.cid AS dst, CAST(count(*) AS DOUBLE) AS w "
    "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey "
    "JOIN (SELECT p_brand, min(p_partkey) AS cid FROM part GROUP BY p_brand) b ON p.p_brand = b.p_brand GROUP BY ALL"
)

DOC_WORDS = word_counts("documents", "doc_id", "text")
DOC_TFIDF = tfidf(DOC_WORDS)
PART_WORDS = word_counts("part", "p_partkey", "p_name")
PART_TFIDF = tfidf(PART_WORDS)

# --- similarities ----------------------------------------------------------------------------

def call_similarity(edges: str) -> str:
    """M1 over an edge query ``(src, dst, w)``; symmetric, diagonal included, zeros dropped."""
    return f"""
    WITH e AS (SELECT src, dst, sum(w) AS w FROM ({edges}) GROUP BY ALL HAVING sum(w) <> 0),
    inc AS (SELECT dst AS node, sum(w) AS tot FROM e GROUP BY dst),
    pairs AS (SELECT src AS i, dst AS j FROM e UNION SELECT dst, src FROM e),
    x AS (
      SELECT p.i, p.j,
        coalesce(eij.w / nullif(ij.tot, 0), 0) + coalesce(eji.w / nullif(ii.tot, 0), 0) AS num,
        (CASE WHEN coalesce(ii.tot, 0) <> 0 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(ij.tot, 0) <> 0 THEN 1 ELSE 0 END) AS den
      FROM pairs p
      LEFT JOIN e eij ON eij.src = p.i AND eij.dst = p.j
      LEFT JOIN e eji ON eji.src = p.j AND eji.dst = p.i
      LEFT JOIN inc ii ON ii.node = p.i
      LEFT JOIN inc ij ON ij.node = p.j
    )
    SELECT i, j, CASE WHEN den > 0 THEN num / den ELSE 0 END AS sim FROM x
    WHERE (CASE WHEN den > 0 THEN num / den ELSE 0 END) <> 0
    """


def cousage_similarity(edges: str) -> str:
    """M2: Jaccard of caller sets."""
    return f"""
    WITH c AS (SELECT DISTINCT src AS caller, dst AS node FROM ({edges}) WHERE w <> 0),
    n AS (SELECT node, count(*) AS n FROM c GROUP BY node),
    inter AS (SELECT a.node AS i, b.node AS j, count(*) AS s FROM c a JOIN c b ON a.caller = b.caller GROUP BY ALL)
    SELECT i, j, s / (ni.n + nj.n - s) AS sim FROM inter
    JOIN n ni ON ni.node = i JOIN n nj ON nj.node = j
    """


def cosine_similarity(vectors: str) -> str:
    """M3 over ``(node, term, x)``; zero vectors have no rows."""
    return f"""
    WITH v AS (SELECT node, term, x FROM ({vectors}) WHERE x <> 0),
    nrm AS (SELECT node, sqrt(sum(x * x)) AS norm FROM v GROUP BY node),
    u AS (SELECT v.node, v.term, v.x / nrm.norm AS u FROM v JOIN nrm USING (node))
    SELECT a.node AS i, b.node AS j, sum(a.u * b.u) AS sim FROM u a JOIN u b ON a.term = b.term
    GROUP BY ALL HAVING sum(a.u * b.u) <> 0
    """


def combined(sims: Sequence[str], weights: Sequence[float]) -> str:
    parts = " UNION ALL ".join(f"SELECT i, j, sim * {dbl(w)} AS sim FROM ({s})" for s, w in zip(sims, weights))
    return f"SELECT i, j, least(sum(sim), 1.0) AS sim FROM ({parts}) GROUP BY i, j HAVING least(sum(sim), 1.0) <> 0"


# --- DBSCAN -----------------------------------------------------------------------------------

def dbscan_ctes(prefix: str, sim: str, nodes: str, eps: float, min_samples: int) -> str:
    """CTEs ``{prefix}_lab(node, label)`` for clustered nodes (label = min core id of the
    component; a border point takes the lowest adjacent label) -- text to put after WITH."""
    p = prefix
    return f"""
    {p}_nb AS (SELECT i, j FROM ({sim}) WHERE {dist('sim')} <= round({dbl(eps)}, 12)),
    {p}_core AS (SELECT i AS node FROM {p}_nb GROUP BY i HAVING count(*) >= {int(min_samples)}),
    {p}_ce AS (SELECT n.i, n.j FROM {p}_nb n JOIN {p}_core a ON a.node = n.i JOIN {p}_core b ON b.node = n.j WHERE n.i <> n.j),
    {p}_cc AS (
      SELECT node, node AS label FROM {p}_core
      UNION
      SELECT ce.j AS node, cc.label FROM {p}_cc cc JOIN {p}_ce ce ON cc.node = ce.i
    ),
    {p}_corelab AS (SELECT node, min(label) AS label FROM {p}_cc GROUP BY node),
    {p}_border AS (
      SELECT n.i AS node, min(cl.label) AS label FROM {p}_nb n JOIN {p}_corelab cl ON cl.node = n.j
      WHERE n.i <> n.j AND n.i NOT IN (SELECT node FROM {p}_core) GROUP BY n.i
    ),
    {p}_lab AS (SELECT node, label FROM {p}_corelab UNION ALL SELECT node, label FROM {p}_border),
    {p}_moves AS (
      SELECT l.node, c.new FROM {p}_lab l JOIN (SELECT label, min(node) AS new FROM {p}_lab GROUP BY label) c USING (label)
    )"""


def dbscan_labels(sim: str, nodes: str, eps: float, min_samples: int) -> str:
    """``(idx, cid)`` for every node, cid = min member id, noise = -1."""
    return f"""
    WITH RECURSIVE {dbscan_ctes('d', sim, nodes, eps, min_samples)}
    SELECT CAST(n.node AS BIGINT) AS idx, CAST(coalesce(m.new, -1) AS BIGINT) AS cid
    FROM ({nodes}) n LEFT JOIN d_moves m USING (node)
    """


def term_ladder(vectors: str, atoms: str, plan: Sequence[float], min_samples: int) -> str:
    """C9/C10 for one term analysis: layers ``(layer, idx, cid)``; each step contracts the
    raw vectors by the previous layer (sum; cosine ignores scale), clusters and projects."""
    ctes = [f"a0 AS (SELECT CAST(idx AS BIGINT) AS idx, CAST(idx AS BIGINT) AS cid FROM ({atoms}))"]
    for k, eps in enumerate(plan, start=1):
        prev = f"a{k - 1}"
        vec = f"SELECT p.cid AS node, v.term, sum(v.x) AS x FROM ({vectors}) v JOIN {prev} p USING (idx) GROUP BY ALL"
        nodes = f"SELECT DISTINCT p.cid AS node FROM {prev} p JOIN (SELECT DISTINCT idx FROM ({vectors})) s USING (idx)"
        ctes.append(f"v{k} AS ({vec})")
        ctes.append(f"s{k} AS ({cosine_similarity(f'SELECT * FROM v{k}')})")
        ctes.append(dbscan_ctes(f"d{k}", f"SELECT * FROM s{k}", nodes, eps, min_samples).strip())
        ctes.append(
            f"a{k} AS (SELECT p.idx, coalesce(m.new, p.cid) AS cid FROM {prev} p LEFT JOIN d{k}_moves m ON m.node = p.cid)"
        )
    union = " UNION ALL ".join(f"SELECT {k} AS layer, idx, cid FROM a{k}" for k in range(len(plan) + 1))
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT CAST(layer AS INTEGER) AS layer, idx, cid FROM ({union})"


# --- several stages ---------------------------------------------------------------------------

def _child(kind: str, features: str, prev: str) -> str:
    """The similarity of one child at the assignment ``prev(idx, cid)``."""
    if kind == "cosine":
        return cosine_similarity(
            f"SELECT p.cid AS node, v.term, sum(v.x) AS x FROM ({features}) v JOIN {prev} p USING (idx) GROUP BY ALL")
    edges = (f"SELECT s.cid AS src, d.cid AS dst, sum(e.w) AS w FROM ({features}) e "
             f"JOIN {prev} s ON s.idx = e.src JOIN {prev} d ON d.idx = e.dst GROUP BY ALL")
    return call_similarity(edges) if kind == "call" else cousage_similarity(edges)


def layers_of_plan(inputs: dict[str, str], atoms: str, stages: Sequence[Sequence[tuple[str, str]]],
                   plan: Sequence[tuple[int, float]], min_samples: int) -> str:
    """CTEs and the last assignment's number of a run over several stages.

    ``inputs``: name -> feature query; ``stages``: per stage its children ``(kind, input name)``, the
    mean of their similarities counts.  Text to put after WITH RECURSIVE; layer k is table ``a{k}(idx, cid)``.
    """
    ctes = [f"in_{name} AS MATERIALIZED ({sql})" for name, sql in inputs.items()]
    ctes.append(f"a0 AS MATERIALIZED (SELECT CAST(idx AS BIGINT) AS idx, CAST(idx AS BIGINT) AS cid FROM ({atoms}))")
    for k, (stage, eps) in enumerate(plan, start=1):
        prev, children = f"a{k - 1}", stages[stage]
        sims = []
        for c, (kind, name) in enumerate(children):
            ctes.append(f"s{k}_{c} AS MATERIALIZED ({_child(kind, f'SELECT * FROM in_{name}', prev)})")
            sims.append(f"SELECT * FROM s{k}_{c}")
        sim = sims[0] if len(sims) == 1 else combined(sims, [1.0 / len(sims)] * len(sims))
        ctes.append(f"t{k} AS MATERIALIZED ({sim})")
        ctes.append(dbscan_ctes(f"d{k}", f"SELECT * FROM t{k}", "", eps, min_samples).strip())
        ctes.append(f"a{k} AS MATERIALIZED (SELECT p.idx, coalesce(m.new, p.cid) AS cid FROM {prev} p "
                    f"LEFT JOIN d{k}_moves m ON m.node = p.cid)")
    return ",\n".join(ctes)


def all_layers(ctes: str, n_steps: int) -> str:
    union = " UNION ALL ".join(f"SELECT {k} AS layer, idx, cid FROM a{k}" for k in range(n_steps + 1))
    return f"WITH RECURSIVE {ctes}\nSELECT CAST(layer AS INTEGER) AS layer, idx, cid FROM ({union})"


# Documents on shelves: language, source and the number of digits of the length.
SHELVED = (
    "SELECT doc_id, text, lang, source, lang || '/' || source || '/' || CAST(length(CAST(n_chars AS VARCHAR)) AS VARCHAR) "
    "AS atom, dense_rank() OVER (ORDER BY lang || '/' || source || '/' || CAST(length(CAST(n_chars AS VARCHAR)) AS VARCHAR)) "
    "- 1 AS idx FROM documents")
SHELVES = f"SELECT DISTINCT atom, CAST(idx AS BIGINT) AS idx FROM ({SHELVED})"
SHELF_TFIDF = tfidf(word_counts(f"({SHELVED})", "idx", "text"))
SHELF_BY_LANG = trace_edges(f"({SHELVED})", "lang", ["doc_id"], "idx")
SHELF_BY_SOURCE = trace_edges(f"(SELECT * FROM ({SHELVED}) WHERE lang = 'en')", "source", ["doc_id"], "idx")
