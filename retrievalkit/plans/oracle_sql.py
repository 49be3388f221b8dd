"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Brute force on purpose: the oracle states the semantics, Spark runs the plan.
Scores use the same sequential double sums (``list_dot_product`` has the
same bits as the Spark expression) and the same rounding points.
"""

from __future__ import annotations

KS = (1, 3, 5, 10)

VEC = "SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS vec, label FROM embeddings"


def score_sql(metric: str, q: str = "q.vec", c: str = "c.vec") -> str:
    if metric == "dot":
        return f"list_dot_product({q}, {c})"
    if metric == "cosine":
        return (f"CASE WHEN sqrt(list_dot_product({q}, {q})) * sqrt(list_dot_product({c}, {c})) > 0 "
                f"THEN list_dot_product({q}, {c}) / (sqrt(list_dot_product({q}, {q})) * "
                f"sqrt(list_dot_product({c}, {c}))) END")
    if metric == "sq_l2":
        return (f"list_reduce(list_transform(list_zip({q}, {c}), lambda p: (p[1] - p[2]) * (p[1] - p[2])), "
                f"lambda a, b: a + b)")
    raise ValueError(metric)


def knn_label_run(metric: str = "cosine", k: int = 10) -> str:
    order = "score DESC" if metric != "sq_l2" else "score ASC"
    return f"""
    SELECT '{metric}' AS run_id, query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT query_id, doc_id, score,
             row_number() OVER (PARTITION BY query_id ORDER BY {order}, doc_id ASC) AS rank
      FROM (SELECT q.id AS query_id, c.id AS doc_id, round({score_sql(metric)}, 6) AS score
            FROM ({VEC}) q, ({VEC}) c WHERE q.id <> c.id) s
      WHERE score IS NOT NULL) r
    WHERE rank <= {k}"""


def per_query_from(judged: str, num_rel: str, ks=KS, digits: int | None = 6) -> str:
    """Per-query metrics from a judged run (run_id, query_id, doc_id, score,
    rank, rel) and (query_id, num_rel)."""
    kmax = max(ks)
    aggs, outs = [], []
    for k in ks:
        aggs += [
            f"sum(CASE WHEN er <= {k} AND rel > 0 THEN 1.0 / log2(er + 1) ELSE 0 END) AS dcg_{k}",
            f"sum(CASE WHEN er <= {k} AND rel > 0 THEN cum_rel / er ELSE 0 END) AS ap_{k}",
            f"sum(CASE WHEN er <= {k} AND rel > 0 THEN 1 ELSE 0 END) AS hits_{k}",
            f"max(CASE WHEN mr <= {k} AND rel > 0 THEN 1.0 / mr END) AS rr_{k}",
        ]

    def rnd(x):
        return f"round({x}, {digits})" if digits is not None else x

    has = "n.num_rel IS NOT NULL AND n.num_rel > 0"
    for k in ks:
        idcg = (f"list_reduce(list_transform(range(1, least({k}, n.num_rel) + 1), "
                f"lambda i: 1.0 / log2(i + 1)), lambda a, b: a + b)")
        outs.append(rnd(f"CASE WHEN {has} THEN dcg_{k} / {idcg} END") + f" AS ndcg_at_{k}")
    for k in ks:
        outs.append(rnd(f"CASE WHEN {has} THEN ap_{k} / n.num_rel END") + f" AS map_at_{k}")
    for k in ks:
        outs.append(rnd(f"CASE WHEN {has} THEN hits_{k} / n.num_rel END") + f" AS recall_at_{k}")
    for k in ks:
        outs.append(rnd(f"CASE WHEN {has} THEN hits_{k} / {float(k)} END") + f" AS precision_at_{k}")
    for k in ks:
        outs.append(rnd(f"coalesce(rr_{k}, 0.0)") + f" AS mrr_at_{k}")
    return f"""
    SELECT a.run_id, a.query_id, {", ".join(outs)} FROM (
      SELECT run_id, query_id, {", ".join(aggs)} FROM (
        SELECT *,
          row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, doc_id DESC) AS er,
          sum(rel) OVER (PARTITION BY run_id, query_id ORDER BY score DESC, doc_id DESC
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_rel,
          row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, rank ASC, doc_id ASC) AS mr
        FROM ({judged}) j) e
      WHERE er <= {kmax} OR mr <= {kmax}
      GROUP BY run_id, query_id) a
    LEFT JOIN ({num_rel}) n ON n.query_id = a.query_id"""


def label_judged(metric: str = "cosine", k: int = 10) -> tuple[str, str]:
    judged = f"""
      SELECT r.*, CASE WHEN ql.label = dl.label THEN 1 ELSE 0 END AS rel
      FROM ({knn_label_run(metric, k)}) r
      JOIN ({VEC}) ql ON ql.id = r.query_id JOIN ({VEC}) dl ON dl.id = r.doc_id"""
    num_rel = f"""
      SELECT v.id AS query_id, g.n - 1 AS num_rel
      FROM ({VEC}) v JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) g
        ON g.label = v.label WHERE g.n - 1 > 0"""
    return judged, num_rel


def label_per_query(metric: str = "cosine", ks=KS) -> str:
    judged, nr = label_judged(metric, max(max(ks), 10))
    return per_query_from(judged, nr, ks)


def metrics_from(per_query_unrounded: str, ks=KS) -> str:
    names = [f"{m}_at_{k}" for m in ("ndcg", "map", "recall", "precision", "mrr") for k in ks]
    cols = ", ".join(f"round(avg({n}), 5) AS {n}" for n in names)
    return f"""
    SELECT run_id, {cols}, count(*) AS n_run_queries, count({names[0]}) AS n_judged_queries
    FROM ({per_query_unrounded}) p GROUP BY run_id"""


def label_metrics(metric: str = "cosine", ks=KS) -> str:
    judged, nr = label_judged(metric, max(max(ks), 10))
    return metrics_from(per_query_from(judged, nr, ks, digits=None), ks)


# ---- conversation triples (F3) and the datasets built from them --------------------

PAIRS = """
  c_ AS (SELECT conv_id, turn, role, text FROM conversations),
  u_ AS (SELECT conv_id, turn, text AS query FROM c_ WHERE role = 'user'),
  a_ AS (SELECT conv_id, turn - 1 AS turn, text AS positive FROM c_ WHERE role = 'assistant'),
  pr_ AS (SELECT u_.conv_id, u_.turn, query, positive FROM u_ JOIN a_ USING (conv_id, turn)),
  nx_ AS (SELECT conv_id, turn - 2 AS turn, positive AS next_pos FROM pr_),
  ft_ AS (SELECT conv_id, min(turn) AS turn FROM pr_ GROUP BY conv_id),
  fp_ AS (SELECT pr_.conv_id, pr_.positive AS first_pos FROM pr_ JOIN ft_ USING (conv_id, turn)),
  pairs AS (SELECT query, positive, coalesce(next_pos, first_pos) AS negative,
                   row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord, conv_id, turn
            FROM pr_ LEFT JOIN nx_ USING (conv_id, turn) LEFT JOIN fp_ USING (conv_id))"""

TRIPLES = PAIRS + """,
  kept AS (SELECT query, ord, positive, negative FROM (
             SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord) AS rn FROM pairs) t
           WHERE rn = 1),
  tq AS (SELECT 'q-' || CAST(n AS VARCHAR) AS query_id, query AS text, n AS ord, positive, negative
         FROM (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS n FROM kept) t),
  tdocs AS (SELECT text, min(p) AS p FROM (
              SELECT positive AS text, ord * 2 AS p FROM kept
              UNION ALL SELECT negative, ord * 2 + 1 FROM kept) t GROUP BY text),
  tc AS (SELECT 'c-' || CAST(n AS VARCHAR) AS doc_id, text, n AS ord
         FROM (SELECT *, row_number() OVER (ORDER BY p) - 1 AS n FROM tdocs) t),
  tqrels AS (SELECT tq.query_id, tc.doc_id, 1 AS relevance FROM tq JOIN tc ON tc.text = tq.positive
             UNION ALL
             SELECT tq.query_id, tc.doc_id, 0 AS relevance FROM tq JOIN tc ON tc.text = tq.negative)"""


def split_sql(src: str, ratio: float, seed: int = 42) -> str:
    """U3 over a CTE ``src(query_id, ord)``; defines CTE ``tsplits``."""
    return f""",
  rk_ AS (SELECT query_id, ord, row_number() OVER (ORDER BY md5('{seed}:split:' || query_id), query_id) - 1 AS rk,
                 count(*) OVER () AS n FROM {src}),
  lab_ AS (SELECT query_id, ord, CASE WHEN rk < CAST(floor(n * {ratio!r}) AS BIGINT) THEN 'val' ELSE 'train' END AS split
           FROM rk_),
  tsplits AS (SELECT query_id, split, row_number() OVER (PARTITION BY split ORDER BY ord, query_id) - 1 AS ord
              FROM lab_)"""


def dev_sql(seed: int = 42, frac: float = 0.5) -> str:
    """U6 over CTE ``tsplits``; defines ``tdev``."""
    return f""",
  tr_ AS (SELECT query_id, ord, row_number() OVER (ORDER BY md5('{seed}:dev:' || query_id), query_id) - 1 AS rk,
                 count(*) OVER () AS n FROM tsplits WHERE split = 'train'),
  tdev AS (SELECT query_id, CASE WHEN rk < CAST(ceil(n * {frac!r}) AS BIGINT) THEN 'dev' ELSE 'train' END AS split, ord
           FROM tr_
           UNION ALL
           SELECT query_id, CASE WHEN split = 'val' THEN 'test' ELSE split END, ord
           FROM tsplits WHERE split <> 'train')"""


# ---- judged import (F4) -----------------------------------------------------------------

JUDGED = """
  jd_ AS (SELECT doc_id, text, lang, source FROM documents),
  jc_ AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, -doc_id AS o FROM jd_
          UNION ALL SELECT CAST(doc_id AS VARCHAR), text || ' (second version)', doc_id + 1 FROM jd_
          WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
  jcorpus AS (SELECT doc_id, text, row_number() OVER (ORDER BY first, doc_id) - 1 AS ord
              FROM (SELECT doc_id, arg_max(text, o) AS text, min(o) AS first FROM jc_ GROUP BY doc_id) t),
  jq_ AS (SELECT lang || '-' || source AS query_id, lang || '-' || source || ' as of ' || CAST(doc_id AS VARCHAR) AS text,
                 doc_id AS o FROM jd_),
  jqueries AS (SELECT query_id, text, row_number() OVER (ORDER BY first, query_id) - 1 AS ord
               FROM (SELECT query_id, arg_max(text, o) AS text, min(o) AS first FROM jq_ GROUP BY query_id) t),
  jqrels AS (SELECT DISTINCT d.lang || '-' || d.source AS query_id, CAST(l.doc_id AS VARCHAR) AS doc_id,
                    CAST(l.relevance AS INTEGER) AS relevance
             FROM (SELECT doc_id, quality AS relevance FROM labels
                   UNION ALL SELECT doc_id, 1 - quality FROM labels WHERE toxic = 1) l
             JOIN jd_ d ON d.doc_id = l.doc_id)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# ---- text path (E2 vectors, R2 run) -------------------------------------------------------


def hash_embed_sql(src: str, out: str, dim: int = 64, instruction: str | None = None) -> str:
    """E2 over CTE ``src(id, text)``; defines CTE ``out(id, vec FLOAT[])``."""
    text = f"'{instruction}' || text" if instruction else "text"
    return f""",
  {out}_s AS (SELECT id, {text} AS text FROM {src}),
  {out}_t AS (SELECT id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)')) AS tok FROM {out}_s),
  {out}_b AS (SELECT id, ('0x' || substr(md5(tok), 1, 4))::INTEGER % {dim} AS b, count(*) AS c
              FROM {out}_t GROUP BY id, b),
  {out}_d AS (SELECT s.id, list(coalesce(b.c, 0)::DOUBLE ORDER BY r.i) AS cnt
              FROM {out}_s s CROSS JOIN range(0, {dim}) r(i)
              LEFT JOIN {out}_b b ON b.id = s.id AND b.b = r.i GROUP BY s.id),
  {out} AS (SELECT id, (CASE WHEN sqrt(list_dot_product(cnt, cnt)) > 0
                             THEN list_transform(cnt, lambda x: x / sqrt(list_dot_product(cnt, cnt)))
                             ELSE cnt END)::FLOAT[] AS vec FROM {out}_d)"""


TEXT_BASE = TRIPLES + split_sql("tq", 0.1, 42)


def text_vectors(split: str | None = None, dim: int = 64, qname: str = "qv", cname: str = "cv") -> str:
    where = f"WHERE s.split = '{split}'" if split else ""
    return f""",
  {qname}_src AS (SELECT q.query_id AS id, q.text FROM tq q
                  {"JOIN tsplits s USING (query_id)" if split else ""} {where}),
  {cname}_src AS (SELECT doc_id AS id, text FROM tc)""" + \
        hash_embed_sql(f"{qname}_src", qname, dim, "query: ") + hash_embed_sql(f"{cname}_src", cname, dim)


def text_distance_run(split: str | None = None, k: int = 100) -> str:
    """CTE ``drun``: squared-L2 top-k of query vectors ``qv`` over ``cv``."""
    return f""",
  drun AS (SELECT 'hash64' AS run_id, query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score ASC, doc_id ASC) AS rank
             FROM (SELECT q.id AS query_id, c.id AS doc_id,
                          round({score_sql('sq_l2', 'q.vec::DOUBLE[]', 'c.vec::DOUBLE[]')}, 6) AS score
                   FROM qv q, cv c) s) r WHERE rank <= {k}),
  trun AS (SELECT run_id, query_id, doc_id, 1.0 / (1.0 + score) AS score, rank FROM drun)"""


#: F2: benchmark items as queries over all documents, relevant if contained.
PASSAGES = """
  tq AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text, item_id AS ord FROM benchmark),
  tc AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, doc_id AS ord FROM documents),
  tqrels AS (SELECT query_id, doc_id, 1 AS relevance FROM tq JOIN tc ON contains(tc.text, tq.text))"""


def text_ctes(split: str | None = None, k: int = 100, dim: int = 64) -> str:
    return TEXT_BASE + text_vectors(split, dim) + text_distance_run(split, k)


# ---- synthesis (Q*) ----------------------------------------------------------------------


def prompt_sql(text_col: str = "text", n: int = 10) -> str:
    from retrievalkit.operators.synth import DEFAULT_QA_TEMPLATE, template_parts

    vals = {"context_str": text_col, "num_questions_per_chunk": f"'{n}'"}
    out = []
    for kind, v in template_parts(DEFAULT_QA_TEMPLATE):
        out.append("'" + v.replace("'", "''") + "'" if kind == "lit" else vals[v])
    return " || ".join(out)


PARSED = PAIRS + """,
  okp AS (SELECT conv_id, turn, query, positive FROM pairs
          WHERE coalesce(query, '') <> '' AND coalesce(positive, '') <> ''),
  parsed AS (SELECT CAST(conv_id AS VARCHAR) AS corpus_id,
                    list(query ORDER BY turn) AS questions, list(positive ORDER BY turn) AS answer,
                    false AS is_malformed
             FROM okp WHERE conv_id % 7 NOT IN (3, 4) GROUP BY conv_id
             UNION ALL
             SELECT DISTINCT CAST(conv_id AS VARCHAR), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), true
             FROM pairs WHERE conv_id % 7 IN (3, 4)),
  qa AS (SELECT 'q-' || CAST(conv_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS query_id,
                CAST(conv_id AS VARCHAR) AS corpus_id, query AS question, positive AS answer, i
         FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM okp
               WHERE conv_id % 7 NOT IN (3, 4)) t
         WHERE length(query) > 5 AND length(positive) > 5)"""


# ---- NUDGE (N*) over the conversation dataset's hash vectors -----------------------------

def _dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def nudge_base(dim: int = 64, doc_filter: str | None = None, more: str = "", splits: str = "tsplits") -> str:
    """CTEs: qv (all queries), cv (corpus), tsplits, tgt(doc_id, g), ut(doc_id, u);
    ``doc_filter`` limits which documents get targets (N6: the new ones);
    ``splits``: the CTE of splits to use, which ``more`` may define."""
    extra = f" AND ({doc_filter})" if doc_filter else ""
    return TEXT_BASE + more + text_vectors(None, dim) + f""",
  trpos AS (SELECT DISTINCT r.query_id, r.doc_id FROM tqrels r JOIN {splits} s USING (query_id)
            WHERE r.relevance = 1 AND s.split = 'train'{extra}),
  tgt AS (SELECT doc_id, list(s ORDER BY i) AS g FROM (
            SELECT p.doc_id, r.i, sum(q.vec[r.i]::DOUBLE) AS s
            FROM trpos p JOIN qv q ON q.id = p.query_id, range(1, {dim + 1}) r(i)
            GROUP BY p.doc_id, r.i) t GROUP BY doc_id),
  ut AS (SELECT doc_id, CASE WHEN sqrt(list_dot_product(g, g)) > 0
                        THEN list_transform(g, lambda x: x / sqrt(list_dot_product(g, g))) ELSE g END AS u
         FROM tgt)"""


def nudge_m_sql(gm: str, src: str = "cv") -> str:
    """Tuned vectors (id, vec DOUBLE[]) for gamma expression ``gm``."""
    return f"""SELECT d.id, CASE WHEN ut.u IS NOT NULL AND {gm} <> 0
                    THEN list_transform(list_zip(ut.u, d.vec::DOUBLE[]), lambda p: {gm} * p[1] + p[2])
                    ELSE d.vec::DOUBLE[] END AS vec
             FROM {src} d LEFT JOIN ut ON ut.doc_id = d.id"""


def nudge_n_sql(gamma: float, src: str = "cv") -> str:
    import math

    g = float(gamma)
    c = 1.0 - g * g / 2.0
    s = g * math.sqrt(1.0 - g * g / 4.0) if g <= 2.0 else 0.0
    return f"""SELECT id, CASE WHEN u IS NULL OR {_dbl(g)} = 0 THEN vec
                       WHEN t >= {_dbl(c)} THEN u
                       WHEN zn > 0 THEN list_transform(list_zip(vec, zr), lambda p: {_dbl(c)} * p[1] + {_dbl(s)} * (p[2] / zn))
                       ELSE vec END AS vec
             FROM (SELECT *, sqrt(list_reduce(list_transform(zr, lambda x: x * x), lambda a, b: a + b)) AS zn
                   FROM (SELECT *, list_transform(list_zip(u, vec), lambda p: p[1] - t * p[2]) AS zr
                         FROM (SELECT d.id, d.vec::DOUBLE[] AS vec, ut.u,
                                      CASE WHEN ut.u IS NOT NULL THEN list_dot_product(ut.u, d.vec::DOUBLE[]) END AS t
                               FROM {src} d LEFT JOIN ut ON ut.doc_id = d.id) a) b) c"""


def nudge_accuracy_sql(grid, kind: str = "nudge-n", split: str = "val",
                       doc_filter: str | None = None, splits: str = "tsplits", tag: str = "") -> str:
    """Rows (gamma, accuracy, n_queries) over CTEs of ``nudge_base``; a query
    without any score is a miss, not left out. ``doc_filter`` and ``splits`` as
    there; the CTEs' names end in ``tag``."""
    extra = f" AND ({doc_filter})" if doc_filter else ""
    metric = "cosine" if kind == "nudge-n" else "dot"
    parts = []
    for g in sorted(set(float(x) for x in grid) | {0.0}):
        tuned = nudge_n_sql(g) if kind == "nudge-n" else nudge_m_sql(_dbl(g))
        parts.append(f"""
      SELECT {_dbl(g)} AS gamma, query_id, CASE WHEN s IS NOT NULL THEN doc_id END AS doc_id FROM (
        SELECT q.id AS query_id, d.id AS doc_id, round({score_sql(metric, 'q.vec::DOUBLE[]', 'd.vec')}, 6) AS s,
               row_number() OVER (PARTITION BY q.id ORDER BY
                 round({score_sql(metric, 'q.vec::DOUBLE[]', 'd.vec')}, 6) DESC NULLS LAST, d.id) AS r
        FROM vq{tag} q, ({tuned}) d) t WHERE r = 1""")
    return f"""
      vrel{tag} AS (SELECT DISTINCT r.query_id, r.doc_id FROM tqrels r JOIN {splits} s USING (query_id)
               WHERE r.relevance = 1 AND s.split = '{split}'{extra}),
      vq{tag} AS (SELECT * FROM qv WHERE id IN (SELECT query_id FROM vrel{tag})),
      top1{tag} AS ({" UNION ALL ".join(parts)}),
      acc{tag} AS (SELECT gamma, avg(CASE WHEN v.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS accuracy,
                     count(*) AS n_queries
              FROM top1{tag} LEFT JOIN vrel{tag} v USING (query_id, doc_id) GROUP BY gamma),
      acc_best{tag} AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, gamma ASC) = 1 AS best FROM acc{tag})"""


def gamma_steps_m_sql(far: float = 2.0) -> str:
    """Steps of NUDGE-M's validation accuracy over CTEs of ``nudge_base``: the
    only relevant document of a query is a line, which every other line beats on
    one side of a crossing, so it leads between the last crossing from below and
    the first from above."""
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    return f"""
      vrel AS (SELECT DISTINCT r.query_id, r.doc_id FROM tqrels r JOIN tsplits s USING (query_id)
               WHERE r.relevance = 1 AND s.split = 'val'),
      lines AS (SELECT q.id AS query_id, d.id AS doc_id, {dot('q.vec::DOUBLE[]', 'd.vec::DOUBLE[]')} AS a,
                       coalesce({dot('q.vec::DOUBLE[]', 'ut.u')}, 0.0) AS b
                FROM qv q, cv d LEFT JOIN ut ON ut.doc_id = d.id
                WHERE q.id IN (SELECT query_id FROM vrel) AND {dot('q.vec::DOUBLE[]', 'q.vec::DOUBLE[]')} > 0),
      own AS (SELECT l.* FROM lines l JOIN vrel USING (query_id, doc_id)),
      rivals AS (SELECT o.query_id, l.a - o.a AS da, l.b - o.b AS db, l.doc_id < o.doc_id AS first
                 FROM own o JOIN lines l ON l.query_id = o.query_id AND l.doc_id <> o.doc_id),
      ends AS (SELECT query_id,
                 max(CASE WHEN db < -1e-12 THEN -da / db WHEN abs(db) <= 1e-12 AND (da > 1e-12 OR (abs(da) <= 1e-12 AND first)) THEN 1e9
                          ELSE 0 END) AS lo,
                 min(CASE WHEN db > 1e-12 THEN -da / db ELSE {far} END) AS hi,
                 bool_or(da > 1e-12 OR (abs(da) <= 1e-12 AND first)) AS lost
               FROM rivals GROUP BY query_id),
      leads AS (SELECT greatest(lo, 0) AS lo, least(hi, {far}) AS hi FROM ends WHERE least(hi, {far}) - greatest(lo, 0) > 1e-9),
      marks AS (SELECT round(x, 9) AS x, sum(c) AS c FROM (
                  SELECT lo AS x, 1 AS c FROM leads UNION ALL SELECT hi, -1 FROM leads
                  UNION ALL SELECT 0.0, 0 UNION ALL SELECT {far}, 0) t GROUP BY 1),
      walked AS (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi, CAST(sum(c) OVER (ORDER BY x) AS BIGINT) AS hits FROM marks),
      nq AS (SELECT count(DISTINCT query_id) AS n FROM vrel),
      steps AS (SELECT lo, hi, hits FROM walked WHERE hi - lo > 1e-9
                UNION ALL SELECT 0.0, 0.0, (SELECT count(*) FROM ends WHERE NOT lost))"""
