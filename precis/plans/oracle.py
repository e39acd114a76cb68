"""DuckDB oracle SQL for every registered query that SQL can express.

Written independently of the Spark plans, from the same specification, over
the pre-registered table views. Regex flavour is RE2 (DuckDB); the patterns
are the ones in ``precis.functions.text``.
"""

from __future__ import annotations

from precis.functions.text import (CLEAN_DROP, SENTENCE_RE, TOKEN_RE, WS_CLASS,
                                   english_stop_words)
from precis.plans import queries as Q
from precis.operators.docrank import NO_TOPIC
from precis.operators.graph import DAMPING, LEXRANK_THRESHOLD
from precis.operators.summarizers import KL_DELTA, LSA_STEPS, LUHN_MAX_GAP, LUHN_MIN_FREQ


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS_CLASS + '+|' + WS_CLASS + '+\\z')}, '', 'g')"


def clean(x: str) -> str:
    collapsed = f"trim(regexp_replace(coalesce({x}, ''), {lit(WS_CLASS + '+')}, ' ', 'g'))"
    return f"regexp_replace({collapsed}, {lit(CLEAN_DROP)}, '', 'g')"


def toks_of(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {lit(TOKEN_RE)})"


def stop_list() -> str:
    return "[" + ", ".join(lit(w) for w in english_stop_words()) + "]"


# ----------------------------------------------------------------- corpus CTEs
def corpus_ctes() -> str:
    return f"""
sent AS (
  SELECT doc_id, sent_id, sentence FROM (
    SELECT d.doc_id, CAST(s.pos - 1 AS INTEGER) AS sent_id, {strip('s.raw')} AS sentence
    FROM documents d, unnest(regexp_extract_all(d.text, {lit(SENTENCE_RE)})) WITH ORDINALITY AS s(raw, pos)
    WHERE length(d.text) > 0) x
  WHERE sentence <> ''),
tok AS (
  SELECT s.doc_id, s.sent_id, CAST(t.pos - 1 AS INTEGER) AS pos, t.word
  FROM sent s, unnest({toks_of('s.sentence')}) WITH ORDINALITY AS t(word, pos))"""


def pick_sql(score_cte: str, k: int, desc: bool = True) -> str:
    """Top-k by round(score, 9) then sent_id, assembled in document order; all docs."""
    order = "DESC" if desc else "ASC"
    return f"""
scored_all AS (
  SELECT s.doc_id, s.sent_id, s.sentence, coalesce(x.score, 0.0) AS score
  FROM sent s LEFT JOIN {score_cte} x ON s.doc_id = x.doc_id AND s.sent_id = x.sent_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) {order}, sent_id) AS rk
  FROM scored_all),
pick AS (
  SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_id) AS summary FROM ranked WHERE rk <= {k}
  GROUP BY doc_id)"""


def all_docs_select(pick: str = "pick") -> str:
    return f"""
SELECT d.doc_id, coalesce(p.summary, '') AS summary
FROM documents d LEFT JOIN {pick} p ON d.doc_id = p.doc_id
WHERE length(d.text) > 0"""


# ----------------------------------------------------------------- scores
def luhn_scores() -> str:
    return f"""
wc AS (SELECT doc_id, word, count(*) AS freq FROM tok GROUP BY doc_id, word),
sig AS (SELECT t.doc_id, t.sent_id, t.pos FROM tok t JOIN wc ON t.doc_id = wc.doc_id AND t.word = wc.word
        WHERE wc.freq >= {LUHN_MIN_FREQ}),
gp AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) - 1 <= {LUHN_MAX_GAP}
                 THEN 0 ELSE 1 END AS brk FROM sig),
cl AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, sent_id ORDER BY pos
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cid FROM gp),
cs AS (SELECT doc_id, sent_id, cid, count(*) * count(*) / (max(pos) - min(pos) + 1) AS sc
       FROM cl GROUP BY doc_id, sent_id, cid),
score AS (SELECT doc_id, sent_id, max(sc) AS score FROM cs GROUP BY doc_id, sent_id)"""


def lsa_scores() -> str:
    return """
tf AS (SELECT doc_id, sent_id, word, count(*) AS tf FROM tok GROUP BY doc_id, sent_id, word),
score AS (SELECT doc_id, sent_id, sqrt(sum(tf * tf)) AS score FROM tf GROUP BY doc_id, sent_id)"""


def lsa_rank_scores(topics: int, steps: int) -> str:
    """CTEs ending in ``score``: block power iteration, columns made orthonormal one after the other by windows."""
    at = range(topics)
    tiny = f"{NO_TOPIC} * w.trace"
    parts = ["""
tf AS MATERIALIZED (SELECT doc_id, sent_id, word, CAST(count(*) AS DOUBLE) AS tf FROM tok GROUP BY doc_id, sent_id, word),
whole AS MATERIALIZED (SELECT doc_id, sum(tf * tf) AS trace FROM tf GROUP BY doc_id),
q0 AS MATERIALIZED (SELECT doc_id, sent_id, """ + ", ".join(
        f"sum(tf * (CAST('0x' || substr(md5('{c}:' || word), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE - 0.5)) AS v{c}" for c in at)
        + " FROM tf GROUP BY doc_id, sent_id)"]
    to_words = ", ".join(f"sum(tf.tf * q.v{c}) AS u{c}" for c in at)
    to_sents = ", ".join(f"sum(tf.tf * u.u{c}) AS v{c}" for c in at)
    for t in range(1, steps + 1):
        body = f"""SELECT tf.doc_id, tf.sent_id, {to_sents} FROM tf JOIN (
  SELECT tf.doc_id, tf.word, {to_words} FROM tf JOIN q{t - 1} q ON tf.doc_id = q.doc_id AND tf.sent_id = q.sent_id
  GROUP BY tf.doc_id, tf.word) u ON tf.doc_id = u.doc_id AND tf.word = u.word GROUP BY tf.doc_id, tf.sent_id"""
        for c in at:
            others = ", ".join(f"v{d}" for d in at if d != c)
            along = "".join(f" - v{d} * sum(v{d} * v{c}) OVER (PARTITION BY doc_id)" for d in range(c))
            rest = f"SELECT doc_id, sent_id{', ' + others if others else ''}, v{c}{along} AS v{c} FROM ({body}) a{c}"
            norm = f"sqrt(sum(v{c} * v{c}) OVER (PARTITION BY x.doc_id))"
            body = (f"SELECT x.doc_id, x.sent_id{', ' + others if others else ''}, "
                    f"CASE WHEN {norm} > {tiny} THEN v{c} / {norm} ELSE 0.0 END AS v{c} "
                    f"FROM ({rest}) x JOIN whole w ON x.doc_id = w.doc_id")
        parts.append(f"q{t} AS MATERIALIZED ({body})")
    products = ", ".join(f"sum(u{c} * u{d}) AS m{c}_{d}" for c in at for d in at)
    square = " + ".join(f"q.v{c} * q.v{d} * h.m{c}_{d}" for c in at for d in at)
    parts.append(f"""h AS (SELECT doc_id, {products} FROM (
  SELECT tf.doc_id, tf.word, {to_words} FROM tf JOIN q{steps} q ON tf.doc_id = q.doc_id AND tf.sent_id = q.sent_id
  GROUP BY tf.doc_id, tf.word) u GROUP BY doc_id),
score AS (SELECT q.doc_id, q.sent_id, sqrt(greatest({square}, 0.0)) AS score FROM q{steps} q JOIN h ON q.doc_id = h.doc_id)""")
    return ",\n".join(parts)


def textrank_edges() -> str:
    return """
lens AS (SELECT doc_id, sent_id, count(*) AS n_tok FROM tok GROUP BY doc_id, sent_id),
dw AS (SELECT DISTINCT doc_id, sent_id, word FROM tok),
pairs AS (SELECT a.doc_id, a.sent_id AS src, b.sent_id AS dst, count(*) AS shared
          FROM dw a JOIN dw b ON a.doc_id = b.doc_id AND a.word = b.word AND a.sent_id < b.sent_id
          GROUP BY a.doc_id, a.sent_id, b.sent_id),
tr_edges AS (
  SELECT p.doc_id, p.src, p.dst, p.shared,
         CASE WHEN ln(la.n_tok) + ln(lb.n_tok) > 0 THEN p.shared / (ln(la.n_tok) + ln(lb.n_tok))
              ELSE 0.0 END AS weight
  FROM pairs p JOIN lens la ON p.doc_id = la.doc_id AND p.src = la.sent_id
               JOIN lens lb ON p.doc_id = lb.doc_id AND p.dst = lb.sent_id)"""


def lexrank_edges() -> str:
    return """
ltf AS (SELECT doc_id, sent_id, word, count(*) AS tf FROM tok GROUP BY doc_id, sent_id, word),
nsent AS (SELECT doc_id, count(*) AS n_sent FROM sent GROUP BY doc_id),
lsf AS (SELECT doc_id, word, count(*) AS sf FROM ltf GROUP BY doc_id, word),
lv AS (SELECT t.doc_id, t.sent_id, t.word, t.tf * ln(n.n_sent / f.sf) AS v
       FROM ltf t JOIN lsf f ON t.doc_id = f.doc_id AND t.word = f.word JOIN nsent n ON t.doc_id = n.doc_id),
lnorm AS (SELECT doc_id, sent_id, sqrt(sum(v * v)) AS nrm FROM lv GROUP BY doc_id, sent_id),
lu AS (SELECT lv.doc_id, lv.sent_id, lv.word, lv.v / n.nrm AS u
       FROM lv JOIN lnorm n ON lv.doc_id = n.doc_id AND lv.sent_id = n.sent_id WHERE lv.v > 0),
lx_edges AS (SELECT a.doc_id, a.sent_id AS src, b.sent_id AS dst, sum(a.u * b.u) AS cosine
             FROM lu a JOIN lu b ON a.doc_id = b.doc_id AND a.word = b.word AND a.sent_id < b.sent_id
             GROUP BY a.doc_id, a.sent_id, b.sent_id)"""


def power_rank(graph: str, steps: int, d: float = DAMPING) -> str:
    """CTEs ending in ``score`` from undirected graph CTE (doc_id, src, dst, w)."""
    parts = [f"""
g AS (SELECT doc_id, src, dst, w FROM {graph} WHERE w > 0),
dir AS MATERIALIZED (SELECT doc_id, src, dst, w FROM g UNION ALL SELECT doc_id, dst AS src, src AS dst, w FROM g),
outw AS MATERIALIZED (SELECT doc_id, src, sum(w) AS ow FROM dir GROUP BY doc_id, src),
trans AS MATERIALIZED (SELECT dir.doc_id, dir.src, dir.dst, dir.w / outw.ow AS p
          FROM dir JOIN outw ON dir.doc_id = outw.doc_id AND dir.src = outw.src),
nn AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id),
info AS MATERIALIZED (SELECT s.doc_id, s.sent_id, nn.n, o.src IS NULL AS dangling
         FROM sent s JOIN nn ON s.doc_id = nn.doc_id
         LEFT JOIN outw o ON s.doc_id = o.doc_id AND s.sent_id = o.src),
r0 AS MATERIALIZED (SELECT doc_id, sent_id, n, dangling, 1.0 / n AS r FROM info)"""]
    for t in range(1, steps + 1):
        p = f"r{t - 1}"
        parts.append(f"""
c{t} AS (SELECT tr.doc_id, tr.dst AS sent_id, sum(tr.p * x.r) AS c
        FROM trans tr JOIN {p} x ON tr.doc_id = x.doc_id AND tr.src = x.sent_id GROUP BY tr.doc_id, tr.dst),
dm{t} AS (SELECT doc_id, sum(r) AS dm FROM {p} WHERE dangling GROUP BY doc_id),
r{t} AS MATERIALIZED (SELECT x.doc_id, x.sent_id, x.n, x.dangling,
               (1.0 - {d}) / x.n + {d} * (coalesce(c.c, 0.0) + coalesce(m.dm, 0.0) / x.n) AS r
        FROM {p} x LEFT JOIN c{t} c ON x.doc_id = c.doc_id AND x.sent_id = c.sent_id
                   LEFT JOIN dm{t} m ON x.doc_id = m.doc_id)""")
    parts.append(f"""
score AS (SELECT doc_id, sent_id, r AS score FROM r{steps})""")
    return ",".join(parts)


def random_pick(k: int, seed: int) -> str:
    return f"""
rk_rand AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
            md5(CAST(doc_id AS VARCHAR) || ':' || CAST(sent_id AS VARCHAR) || ':{seed}'), sent_id) AS rk
  FROM sent),
pick AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_id) AS summary FROM rk_rand
         WHERE rk <= {k} GROUP BY doc_id)"""


def kl_pick(k: int, delta: float = KL_DELTA) -> str:
    parts = [f"""
ktf AS (SELECT doc_id, sent_id, word, count(*) AS cs FROM tok GROUP BY doc_id, sent_id, word),
kdw AS (SELECT doc_id, word, sum(cs) AS cd FROM ktf GROUP BY doc_id, word),
kst AS (SELECT doc_id, sum(cd) AS nd, count(*) AS v FROM kdw GROUP BY doc_id),
kpd AS (SELECT w.doc_id, w.word, w.cd / s.nd AS pd FROM kdw w JOIN kst s ON w.doc_id = s.doc_id),
kct AS (SELECT t.doc_id, t.sent_id, t.word, t.cs, p.pd FROM ktf t JOIN kpd p ON t.doc_id = p.doc_id AND t.word = p.word),
kns AS (SELECT doc_id, sent_id, sum(cs) AS ns FROM ktf GROUP BY doc_id, sent_id),
kbase AS (SELECT s.doc_id, s.sent_id, coalesce(n.ns, 0) AS ns, coalesce(st.v, 0) AS v
          FROM sent s LEFT JOIN kns n ON s.doc_id = n.doc_id AND s.sent_id = n.sent_id
          LEFT JOIN kst st ON s.doc_id = st.doc_id)"""]
    for r in range(k):
        if r == 0:
            parts.append(f"""
kg0 AS (SELECT doc_id, sent_id, sum(pd * (ln(0.0 + cs + {delta}) - ln(0.0 + {delta}))) AS gain
        FROM kct GROUP BY doc_id, sent_id),
kj0 AS (SELECT b.doc_id, b.sent_id,
               CASE WHEN b.v > 0 THEN ln(0 + b.ns + {delta} * b.v) - coalesce(g.gain, 0.0) ELSE 0.0 END AS score
        FROM kbase b LEFT JOIN kg0 g ON b.doc_id = g.doc_id AND b.sent_id = g.sent_id)""")
        else:
            prev = f"kch{r - 1}"
            parts.append(f"""
ksc{r} AS (SELECT t.doc_id, t.word, sum(t.cs) AS cS FROM ktf t
          JOIN {prev} c ON t.doc_id = c.doc_id AND t.sent_id = c.sent_id GROUP BY t.doc_id, t.word),
knS{r} AS (SELECT c.doc_id, sum(b.ns) AS nS FROM {prev} c
          JOIN kbase b ON c.doc_id = b.doc_id AND c.sent_id = b.sent_id GROUP BY c.doc_id),
kg{r} AS (SELECT t.doc_id, t.sent_id,
                sum(t.pd * (ln(coalesce(s.cS, 0) + t.cs + {delta}) - ln(coalesce(s.cS, 0) + {delta}))) AS gain
         FROM kct t LEFT JOIN ksc{r} s ON t.doc_id = s.doc_id AND t.word = s.word GROUP BY t.doc_id, t.sent_id),
kj{r} AS (SELECT b.doc_id, b.sent_id,
                CASE WHEN b.v > 0 THEN ln(coalesce(n.nS, 0) + b.ns + {delta} * b.v) - coalesce(g.gain, 0.0)
                     ELSE 0.0 END AS score
         FROM kbase b LEFT JOIN kg{r} g ON b.doc_id = g.doc_id AND b.sent_id = g.sent_id
         LEFT JOIN knS{r} n ON b.doc_id = n.doc_id
         WHERE NOT EXISTS (SELECT 1 FROM {prev} c WHERE c.doc_id = b.doc_id AND c.sent_id = b.sent_id))""")
        parts.append(f"""
kb{r} AS (SELECT doc_id, sent_id FROM (
           SELECT doc_id, sent_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9), sent_id) AS rk
           FROM kj{r}) z WHERE rk = 1),
kch{r} AS ({'SELECT * FROM kb0' if r == 0 else f'SELECT * FROM kch{r - 1} UNION ALL SELECT * FROM kb{r}'})""")
    parts.append(f"""
pick AS (SELECT s.doc_id, string_agg(s.sentence, ' ' ORDER BY s.sent_id) AS summary
         FROM sent s JOIN kch{k - 1} c ON s.doc_id = c.doc_id AND s.sent_id = c.sent_id GROUP BY s.doc_id)""")
    return ",".join(parts)


def summary_sql(name: str) -> str:
    """Full query: (doc_id, summary) of one extractive model over all documents."""
    k = Q.K
    if name == "random":
        body = random_pick(k, Q.SEED)
    elif name == "kl":
        body = kl_pick(k)
    elif name == "luhn":
        body = luhn_scores() + "," + pick_sql("score", k)
    elif name == "lsa":
        body = lsa_scores() + "," + pick_sql("score", k)
    elif name == "lsa_rank":
        body = lsa_rank_scores(k, LSA_STEPS) + "," + pick_sql("score", k)
    elif name == "reduction":
        body = (textrank_edges() + """,
score AS (SELECT doc_id, sent_id, sum(weight) AS score FROM (
  SELECT doc_id, src AS sent_id, weight FROM tr_edges UNION ALL SELECT doc_id, dst, weight FROM tr_edges) u
  GROUP BY doc_id, sent_id)""" + "," + pick_sql("score", k))
    elif name == "textrank":
        body = (textrank_edges() + """,
trg AS (SELECT doc_id, src, dst, weight AS w FROM tr_edges)""" + "," + power_rank("trg", Q.RANK_STEPS)
                + "," + pick_sql("score", k))
    elif name == "lexrank":
        body = (lexrank_edges() + f""",
lxg AS (SELECT doc_id, src, dst, 1.0 AS w FROM lx_edges WHERE cosine > {LEXRANK_THRESHOLD})"""
                + "," + power_rank("lxg", Q.RANK_STEPS) + "," + pick_sql("score", k))
    else:
        raise KeyError(name)
    return body


def with_summary(name: str, tail: str, extra: str = "") -> str:
    """WITH <corpus>, <summary ctes>, summ_<name> AS (...) <extra> <tail>."""
    return (f"WITH {corpus_ctes()},{summary_sql(name)},\nsumm AS ({all_docs_select()})"
            + (("," + extra) if extra else "") + "\n" + tail)


# ----------------------------------------------------------------- split
def split_ctes(ids_sql: str, seed: int = 42, test_size: float = 0.25) -> str:
    """CTEs ids/split from ``ids_sql`` returning (doc_id, category)."""
    return f"""
ids AS ({ids_sql}),
cc AS (SELECT category, count(*) AS n_c FROM ids GROUP BY category),
tot AS (SELECT sum(n_c) AS n, min(n_c) >= 2 AS strat FROM cc),
q0 AS (SELECT cc.category, cc.n_c, tot.n, tot.strat,
              tot.n - CAST(ceil(tot.n * {test_size}) AS BIGINT) AS n_train FROM cc, tot),
q1 AS (SELECT *, (n_c * n_train) // n AS fl, (n_c * n_train) % n AS rem FROM q0),
q2 AS (SELECT *, n_train - sum(fl) OVER () AS short, row_number() OVER (ORDER BY rem DESC, category) AS rk FROM q1),
q AS (SELECT category, CASE WHEN strat THEN 'c:' || category ELSE 'all' END AS grp,
             CASE WHEN strat THEN fl + CASE WHEN rk <= short THEN 1 ELSE 0 END ELSE n_train END AS quota FROM q2),
rn AS (SELECT i.doc_id, i.category, q.quota,
              row_number() OVER (PARTITION BY q.grp ORDER BY md5(CAST(i.doc_id AS VARCHAR) || ':{seed}'),
                                 CAST(i.doc_id AS VARCHAR)) AS r
       FROM ids i JOIN q ON i.category = q.category),
split AS (SELECT doc_id, category, CASE WHEN r <= quota THEN 'train' ELSE 'test' END AS fold FROM rn)"""


def recs_sql(model: str, labels_sql: str) -> str:
    """Label join of summ (doc_id, summary) with labels_sql (doc_id, category)."""
    return f"""
SELECT '{model}' || '__' || CAST(s.doc_id AS VARCHAR) AS unique_id, '{model}' AS model,
       CAST(s.doc_id AS VARCHAR) AS resume_id, {strip('s.summary')} AS summary, CAST(l.category AS VARCHAR) AS category
FROM summ s JOIN ({labels_sql}) l ON s.doc_id = l.doc_id
WHERE {strip('s.summary')} <> '' AND l.doc_id IS NOT NULL AND l.category IS NOT NULL"""


def all_records_ctes(labels_sql: str) -> str:
    """summ_<model> per model and recs, their union joined with the labels."""
    summ = ",\n".join(f"summ_{m} AS (WITH {corpus_ctes()},{summary_sql(m)}\n{all_docs_select()})" for m in Q.MODELS)
    recs = "\nUNION ALL\n".join(recs_sql(m, labels_sql).replace("FROM summ s", f"FROM summ_{m} s") for m in Q.MODELS)
    return f"{summ},\nrecs AS MATERIALIZED ({recs})"


def vocabulary_ctes() -> str:
    """voc(model, term, idf) and what it needs, from recs and split."""
    grams = ("list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), "
             "lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)")
    return f"""
tk AS (SELECT model, resume_id, list_filter({toks_of('summary')}, lambda x: NOT list_contains({stop_list()}, x)) AS t
       FROM recs),
gr AS (SELECT model, resume_id, unnest({grams}) AS term FROM tk),
tf AS MATERIALIZED (SELECT model, resume_id, term, count(*) AS tf FROM gr GROUP BY model, resume_id, term),
train AS (SELECT CAST(doc_id AS VARCHAR) AS resume_id FROM split WHERE fold = 'train'),
ntr AS (SELECT model, count(*) AS n FROM recs WHERE resume_id IN (SELECT resume_id FROM train) GROUP BY model),
dfq AS (SELECT model, term, count(*) AS df FROM tf WHERE resume_id IN (SELECT resume_id FROM train) GROUP BY model, term),
voc AS (SELECT model, term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM dfq JOIN ntr USING (model)
        WHERE df >= 3 AND df <= 0.9 * n)"""


def unit_reports_sql() -> str:
    """As ``rule_predictions_sql``, per model, language and source of the labelled documents, with err(model, error)."""
    labels = "SELECT doc_id, lang AS category FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
    records = all_records_ctes(labels).replace("\nrecs AS MATERIALIZED", "\nwhole AS MATERIALIZED") + """,
recs AS MATERIALIZED (SELECT w.* REPLACE (w.model || '@' || d.lang || '/' || d.source AS model)
                      FROM whole w JOIN documents d ON w.resume_id = CAST(d.doc_id AS VARCHAR))"""
    return rule_predictions_sql(records, labels, f""",{vocabulary_ctes()},
fc AS (SELECT r.model, count(*) FILTER (WHERE s.fold = 'train') AS tr, count(*) FILTER (WHERE s.fold = 'test') AS te
       FROM recs r JOIN split s ON r.resume_id = CAST(s.doc_id AS VARCHAR) GROUP BY r.model),
err AS (SELECT model, CASE WHEN tr = 0 OR te = 0 THEN 'Insufficient data for split'
                           WHEN model NOT IN (SELECT model FROM voc) THEN 'After pruning, no terms remain' END AS error FROM fc)""")


def rule_predictions_sql(records: str | None = None, labels: str = "SELECT doc_id, lang AS category FROM documents",
                         more: str = "") -> str:
    """preds(model, doc_id, y_true, y_pred), recs and pc(per category) over all models' summaries."""
    t = toks_of("r.summary")
    return f"""
WITH {records or all_records_ctes(labels)},
{split_ctes(labels)}{more},
preds AS (
  SELECT r.model, r.resume_id AS doc_id, r.category AS y_true,
         CASE WHEN list_has_any({t}, ['the', 'and', 'of']) THEN 'en'
              WHEN list_has_any({t}, ['der', 'und', 'die']) THEN 'de'
              WHEN list_has_any({t}, ['les', 'des', 'et']) THEN 'fr'
              ELSE 'es' END AS y_pred
  FROM recs r JOIN split sp ON r.resume_id = CAST(sp.doc_id AS VARCHAR) WHERE sp.fold = 'test'),
labs AS (SELECT DISTINCT category AS lab FROM recs),
mods AS (SELECT DISTINCT model FROM preds),
grid AS (SELECT m.model, a.lab AS y_true, b.lab AS y_pred FROM mods m, labs a, labs b),
cnt AS (SELECT model, y_true, y_pred, count(*) AS n FROM preds GROUP BY model, y_true, y_pred),
cm AS (SELECT g.model, g.y_true, g.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
       FROM grid g LEFT JOIN cnt c ON g.model = c.model AND g.y_true = c.y_true AND g.y_pred = c.y_pred),
bt AS (SELECT model, y_true AS category, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp
       FROM cm GROUP BY model, y_true),
bp AS (SELECT model, y_pred AS category, sum(n) AS npred FROM cm GROUP BY model, y_pred),
pc AS (SELECT bt.model, bt.category,
              CASE WHEN bp.npred > 0 THEN bt.tp / bp.npred ELSE 0.0 END AS precision,
              CASE WHEN bt.support > 0 THEN bt.tp / bt.support ELSE 0.0 END AS recall,
              CASE WHEN bp.npred + bt.support > 0 THEN 2.0 * bt.tp / (bp.npred + bt.support) ELSE 0.0 END AS f1_score,
              CAST(bt.support AS BIGINT) AS support
       FROM bt JOIN bp ON bt.model = bp.model AND bt.category = bp.category)"""


# ----------------------------------------------------------------- queries
def _sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["clean_text"] = f"""
SELECT 'documents' AS src, doc_id AS id, {clean('text')} AS cleaned FROM documents
UNION ALL
SELECT 'pages' AS src, page_id AS id, {clean('html')} AS cleaned FROM pages"""

    cases = " ".join(f"WHEN regexp_matches(stripped, {lit('(?i)' + p)}) THEN {lit(n)}"
                     for n, p in Q.QUERY_SECTION_RULES)
    out["segment_sections"] = f"""
WITH lines AS (
  SELECT d.doc_id, CAST(l.ln - 1 AS INTEGER) AS ln, l.line
  FROM documents d, unnest(string_split(coalesce(d.text, ''), chr(10))) WITH ORDINALITY AS l(line, ln)),
ls AS (SELECT *, {strip('line')} AS stripped FROM lines),
lm AS (SELECT doc_id, ln, line, stripped, CASE {cases} END AS m FROM ls WHERE stripped <> ''),
lc AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'header') AS cur FROM lm),
lp AS (SELECT *, CASE WHEN m IS NOT NULL AND m <> coalesce(lag(cur) OVER (PARTITION BY doc_id ORDER BY ln), 'header')
                      THEN stripped ELSE line END AS piece FROM lc),
sec AS (SELECT doc_id, cur AS section, min(ln) AS first_ln,
               {strip("string_agg(piece, chr(10) ORDER BY ln)")} AS text FROM lp GROUP BY doc_id, cur)
SELECT doc_id, section,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CAST(section <> 'header' AS INTEGER), first_ln) - 1
            AS INTEGER) AS section_ord, text
FROM sec WHERE text <> ''"""

    out["split_sentences"] = f"WITH {corpus_ctes()}\nSELECT doc_id, sent_id, sentence FROM sent"
    out["tokenize_terms"] = (f"WITH {corpus_ctes()}\n"
                             "SELECT doc_id, word, count(*) AS tf FROM tok GROUP BY doc_id, word")

    parent = r"regexp_extract(rel_path, '^(.*)/[^/]*$', 1)"
    name = r"regexp_extract(rel_path, '([^/]*)$', 1)"

    def stem(nm):
        return (f"CASE WHEN regexp_matches({nm}, '^.+\\.[^.]*$') THEN regexp_extract({nm}, '^(.+)\\.[^.]*$', 1) "
                f"ELSE {nm} END")
    out["output_path"] = f"""
WITH p AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(doc_id AS VARCHAR) || '.txt'
                      ELSE lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS rel_path
  FROM documents),
q AS (SELECT doc_id, rel_path, {parent} AS parent, {stem(name)} || '_summary.txt' AS fname FROM p),
r AS (SELECT doc_id, rel_path,
             CASE WHEN parent = '' THEN 'luhn/' || fname ELSE 'luhn/' || parent || '/' || fname END AS preserve_path,
             'luhn/' || CASE WHEN parent = '' THEN fname ELSE replace(parent, '/', '_') || '_' || fname END AS flat_path
      FROM q),
s AS (SELECT *, {stem("regexp_extract(preserve_path, '([^/]*)$', 1)")} AS sp,
                {stem("regexp_extract(flat_path, '([^/]*)$', 1)")} AS sf FROM r)
SELECT doc_id, rel_path, preserve_path, flat_path,
       regexp_replace(sp, '_summary$', '') AS id_preserve,
       regexp_replace(sf, '_summary$', '') AS id_flat,
       'luhn__' || regexp_replace(sf, '_summary$', '') AS unique_id
FROM s"""

    for q, m in [("summ_random", "random"), ("summ_luhn", "luhn"), ("summ_lsa_norm", "lsa"), ("summ_lsa_rank", "lsa_rank"),
                 ("summ_reduction", "reduction"), ("summ_textrank", "textrank"),
                 ("summ_lexrank", "lexrank"), ("summ_kl", "kl")]:
        out[q] = f"WITH {corpus_ctes()},{summary_sql(m)}\n{all_docs_select()}"

    out["sentence_graph_textrank"] = (f"WITH {corpus_ctes()},{textrank_edges()}\n"
                                      "SELECT doc_id, src, dst, shared, round(weight, 6) AS weight FROM tr_edges")
    out["sentence_graph_lexrank"] = (f"WITH {corpus_ctes()},{lexrank_edges()}\n"
                                     "SELECT doc_id, src, dst, round(cosine, 6) AS cosine FROM lx_edges")

    from precis.operators.summarizers import EXTRACTIVE
    avail = list(EXTRACTIVE) + Q.ABSTRACTIVE_STUBS
    chosen = [m for m in Q.GRID_REQUEST if m in avail]
    values = ", ".join(f"({lit(m)}, {i})" for i, m in enumerate(chosen))
    out["model_doc_grid"] = f"""
SELECT m.model, CAST(m.model_ord AS INTEGER) AS model_ord, d.doc_id
FROM documents d, (VALUES {values}) AS m(model, model_ord) WHERE length(d.text) > 0"""

    quality = "SELECT doc_id, CAST(quality AS VARCHAR) AS category FROM labels"
    out["label_join"] = f"WITH {all_records_ctes(quality)}\nSELECT * FROM recs"
    out["corpus_counts"] = f"""WITH {all_records_ctes(quality)}
SELECT model, count(*) AS n_records, count(DISTINCT resume_id) AS n_ids, count(DISTINCT category) AS n_categories
FROM recs GROUP BY model"""
    out["router"] = "\nUNION ALL\n".join(
        f"SELECT '{m}' AS model, doc_id, summary FROM (WITH {corpus_ctes()},{summary_sql(m)}\n{all_docs_select()}) z"
        for m in Q.ROUTER_REQUEST if m in Q.MODELS)
    out["stratified_split"] = (f"WITH {split_ctes('SELECT doc_id, lang AS category FROM documents')}\n"
                               "SELECT doc_id, category, fold FROM split")
    out["stratified_split_quality"] = (f"WITH {split_ctes(quality)}\n"
                                       "SELECT doc_id, category, fold FROM split")

    labels = "SELECT doc_id, lang AS category FROM documents"
    out["tfidf_features"] = f"""
WITH {all_records_ctes(labels)},
{split_ctes("SELECT DISTINCT resume_id AS doc_id, category FROM recs")},{vocabulary_ctes()},
w AS (SELECT tf.model, tf.resume_id, tf.term, tf.tf * voc.idf AS w FROM tf JOIN voc USING (model, term)),
nrm AS (SELECT model, resume_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY model, resume_id)
SELECT model, resume_id, term, round(w / nrm, 6) AS tfidf FROM w JOIN nrm USING (model, resume_id)"""

    out["class_weights"] = f"""
WITH {split_ctes(labels)},
tr AS (SELECT category, count(*) AS n_c FROM split WHERE fold = 'train' GROUP BY category)
SELECT category, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight FROM tr"""

    base = rule_predictions_sql()
    out["confusion_matrix"] = base + "\nSELECT model, y_true, y_pred, n FROM cm"
    out["per_category_metrics"] = base + """
SELECT model, category, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, support FROM pc"""
    out["overall_metrics"] = base + """
SELECT model, round(sum(recall * support) / sum(support), 6) AS accuracy,
       round(sum(f1_score * support) / sum(support), 6) AS f1_weighted, round(avg(f1_score), 6) AS f1_macro
FROM pc GROUP BY model"""
    languages = ["de", "en", "es", "fr"]        # the values of ``lang``: a view's columns can't come from data
    out["category_pivot"] = base + "\nSELECT model, " + ", ".join(
        f"round(coalesce(avg(f1_score) FILTER (WHERE category = {lit(c)}), 0.0), 6) AS {c}" for c in languages) \
        + " FROM pc GROUP BY model"

    units = unit_reports_sql()
    out["success_rows"] = units + """
SELECT model, round(sum(recall * support) / sum(support), 6) AS accuracy,
       round(sum(f1_score * support) / sum(support), 6) AS f1_weighted, round(avg(f1_score), 6) AS f1_macro
FROM pc JOIN err USING (model) WHERE error IS NULL GROUP BY model"""
    out["error_rows"] = units + """
SELECT model, error FROM err WHERE error IS NOT NULL"""
    out["successful_categories"] = units + """
SELECT model, category, round(f1_score, 6) AS f1_score, support FROM pc JOIN err USING (model) WHERE error IS NULL"""

    out["efficiency_report"] = f"""
WITH t AS (SELECT event_type AS model, value AS elapsed_s FROM events),
m AS (SELECT DISTINCT model, 'extractive' AS type FROM t UNION ALL SELECT 'bart', 'abstractive'),
s AS (SELECT model, count(elapsed_s) AS n, sum(elapsed_s) AS tot, min(elapsed_s) AS mn, max(elapsed_s) AS mx
      FROM t GROUP BY model)
SELECT m.model, m.type, CAST(coalesce(s.n, 0) AS BIGINT) AS files_processed,
       round(coalesce(s.tot, 0.0), 6) AS total_s,
       round(CASE WHEN s.n > 0 THEN s.tot / s.n END, 6) AS avg_s,
       round(s.mn, 6) AS min_s, round(s.mx, 6) AS max_s
FROM m LEFT JOIN s ON m.model = s.model"""
    return out


def oracle_sql() -> dict[str, str]:
    return _sql()
