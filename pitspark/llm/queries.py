"""One query per operator on its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, conversations, decontaminate, html_text, lattice, line_dedup, merkle, mixing, ngram_join, quality, token_files, toxicity, url_filter
from .url_filter import Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a session and a folder of tables."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- mixing ---------------------------------------------------------------

MIX_WEIGHTS = [5.0, 2.0, 1.0]

MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * source_size::DOUBLE AS cap
  FROM sizes
), leveled AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
          - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)::DOUBLE)
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM ranked
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         least(cap, coalesce(min_by(level, ratio) FILTER (level <= ratio) OVER (), 'inf'::DOUBLE) * weight) AS target
  FROM leveled
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ranked_before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM placed
)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, budget - passes * source_size - ranked_before)))::BIGINT AS taken
FROM passed
"""


@query("op5_mixing", MIX_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# --- URL filter -----------------------------------------------------------

# The rules of the query's contract.
URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]

URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), numbered AS (
  SELECT row_number() OVER () AS id, * FROM parts
), fits AS (
  SELECT id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM numbered JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY id
)
SELECT page_id, host, path, rule, coalesce(f.verdict, 'allow') AS verdict
FROM numbered LEFT JOIN fits f USING (id)
"""


@query("op2_url_filter", URL_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, URL_RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


# --- benchmark decontamination --------------------------------------------

DECON_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents
), items AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS s FROM items WHERE len(words) > 0)
), runs AS (
  SELECT id, s, n, array_to_string(words[s:s + n - 1], ' ') AS phrase
  FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS s
        FROM docs, (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT r.id, r.s, r.n, w.item_id FROM runs r JOIN windows w ON r.n = w.n AND r.phrase = w.phrase
), covered AS (
  SELECT id, count(DISTINCT p) AS n_hit
  FROM (SELECT id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT id, s, n FROM hits))
  GROUP BY id
), found AS (
  SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT id, coalesce(item_id::VARCHAR, '') AS item_id FROM hits) GROUP BY id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (id) LEFT JOIN found USING (id)
"""


@query("op9_decontamination", DECON_SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
    )
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# --- n-gram Jaccard join --------------------------------------------------

@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "n_links", "copies")


# --- line dedup -----------------------------------------------------------

LINES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, text, coalesce(string_split(text, chr(10)), []) AS lines FROM documents
), windows AS (
  SELECT id, doc_id, s, array_to_string(lines[s:s + 2], chr(10)) AS passage
  FROM (SELECT id, doc_id, lines, unnest(range(1, len(lines) - 1)) AS s FROM docs)
), ranked AS (
  SELECT id, s, row_number() OVER (PARTITION BY passage ORDER BY doc_id NULLS LAST, id, s) AS k FROM windows
), covered AS (
  SELECT DISTINCT id, unnest([s, s + 1, s + 2]) AS p FROM ranked WHERE k > 1
), kept AS (
  SELECT l.id, string_agg(l.line, chr(10) ORDER BY l.p) AS text
  FROM (SELECT id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM docs) l
  ANTI JOIN covered c ON c.id = l.id AND c.p = l.p
  GROUP BY l.id
), gone AS (
  SELECT id, count(*) AS n FROM covered GROUP BY id
)
SELECT d.doc_id, CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       len(d.lines)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed
FROM docs d LEFT JOIN gone g USING (id) LEFT JOIN kept k USING (id)
"""


@query("op1_line_dedup", LINES_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))


# --- quality classifier ---------------------------------------------------

@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model)


# --- HTML extraction ------------------------------------------------------

@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars")


# --- toxicity -------------------------------------------------------------

@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).drop("spans")


# --- token files ----------------------------------------------------------

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer's vocabulary file is; override by PITSPARK_TOKENIZER."""
    import public_tokenizers

    return os.environ.get("PITSPARK_TOKENIZER") or public_tokenizers.path(name)


@query("op7_token_codec")
def op7_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


# --- nearest neighbours ---------------------------------------------------

@query("op8_ann_forest")
def op8_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


# --- Merkle manifest ------------------------------------------------------

MERKLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS id, doc_id, source, lang, n_chars, text,
         doc_id IS NOT NULL AND (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(doc_id::VARCHAR, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1)))) % 5 = 0 AS tampered
  FROM documents
), fields AS (
  SELECT id, doc_id, source, tampered,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text
  FROM docs
), leaves AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM leaves
), inner_nodes AS (
  SELECT s, 0 AS level, i, leaf AS digest, n FROM placed
  UNION ALL
  SELECT s, any_value(level) + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 15) // 16)
  FROM inner_nodes WHERE n > 1 GROUP BY s, i // 16
), tops AS (
  SELECT s AS i, digest FROM inner_nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, i, digest, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT any_value(level) + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 15) // 16)
  FROM upper_nodes WHERE n > 1 GROUP BY i // 16
), root AS (
  SELECT digest AS root FROM upper_nodes WHERE n = 1
), levels AS (
  SELECT s, level, i, digest, n FROM inner_nodes
), runs AS (
  SELECT s, 0 AS part, level, i // 16 AS run, list(digest ORDER BY i) AS members FROM inner_nodes WHERE n > 1 GROUP BY s, level, i // 16
  UNION ALL
  SELECT NULL, 1, level, i // 16, list(digest ORDER BY i) FROM upper_nodes WHERE n > 1 GROUP BY level, i // 16
), steps AS (
  SELECT p.id, r.part, r.level, (p.i // (16 ** r.level)::BIGINT) % 16 AS pos, r.members
  FROM placed p JOIN runs r ON r.part = 0 AND r.s = p.s AND r.run = p.i // (16 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.id, r.part, r.level, (p.s // (16 ** r.level)::BIGINT) % 16, r.members
  FROM placed p JOIN runs r ON r.part = 1 AND r.run = p.s // (16 ** (r.level + 1))::BIGINT
), paths AS (
  SELECT id, list(struct_pack(l := array_to_string(list_slice(members, 1, pos), ''), r := array_to_string(list_slice(members, pos + 2, 16), ''))
                  ORDER BY part, level) AS path
  FROM steps GROUP BY id
), folding AS (
  SELECT p.id, coalesce(changed, leaf) AS digest, 1 AS k, path FROM placed p LEFT JOIN paths q USING (id)
  UNION ALL
  SELECT id, sha256(path[k].l || digest || path[k].r), k + 1, path FROM folding WHERE k <= len(path)
)
SELECT p.doc_id, p.leaf, t.digest AS subroot, root,
       sha256(coalesce(array_to_string(list_transform(f.path, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = root AS verified
FROM placed p JOIN tops t ON t.i = p.s JOIN folding f ON f.id = p.id AND f.k = coalesce(len(f.path), 0) + 1, root
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


# --- conversation repair --------------------------------------------------

REPAIR_SQL = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
             lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1)))) % 20 AS fault
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE fault <> 0
), ids AS (
  SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)
), placed AS (
  SELECT conv, turn, role, text, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged d JOIN ids ON ids.conv_id IS NOT DISTINCT FROM d.conv_id
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv
), inserts(q, q2, label, lines) AS (
  VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
         (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
         (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])
), ops(op) AS (
  VALUES ('D'), ('K'), ('R')
), moves AS (
  SELECT conv, i, q, q2, op, inserts.label || op AS label,
         inserts.lines || CASE op WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                          ELSE [CASE WHEN q2 = 2 THEN 'assistant:' ELSE 'user:' END || text] END AS lines,
         3 * len(inserts.lines) + CASE op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
         + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
         CASE op WHEN 'D' THEN q2 WHEN 'R' THEN CASE WHEN q2 = 2 THEN 3 ELSE 2 END
              ELSE CASE WHEN initial = 's' AND q2 = 0 THEN 1 WHEN initial = 'u' AND q2 <> 2 THEN 2
                        WHEN initial = 'a' AND q2 = 2 THEN 3 END END AS target
  FROM faulty, inserts, ops
  WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate')
), best AS (
  SELECT conv, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS way FROM counted
  UNION ALL
  SELECT m.conv, m.i, m.target,
         min({'cost': (b.way.cost + m.cost)::BIGINT, 'audit': b.way.audit || m.label, 'lines': b.way.lines || m.lines})
  FROM best b JOIN moves m ON m.conv = b.conv AND m.i = b.i + 1 AND m.q = b.q
  WHERE m.target IS NOT NULL GROUP BY m.conv, m.i, m.target
), ended AS (
  SELECT c.conv, min({'cost': (b.way.cost + 3 * len(t.lines))::BIGINT, 'audit': b.way.audit || t.label, 'lines': b.way.lines || t.lines}) AS way
  FROM counted c JOIN best b ON b.conv = c.conv AND b.i = c.n JOIN inserts t ON t.q = b.q AND t.q2 IN (0, 3)
  GROUP BY c.conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.way.cost, 0)::BIGINT AS cost, coalesce(e.way.audit, '') AS audit,
       sha256(coalesce(array_to_string(e.way.lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counted c USING (conv) LEFT JOIN ended e USING (conv)
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


# --- embedding near-dedup -------------------------------------------------

LATTICE_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
  SELECT id, vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.id <> b.id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), reached AS (
  SELECT id AS a, id AS b FROM vectors
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), components AS (
  SELECT r.a AS id, min(v.vec_id) AS component_id FROM reached r JOIN vectors v ON v.id = r.b GROUP BY r.a
), counts AS (
  SELECT a AS id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vectors JOIN components USING (id) LEFT JOIN counts USING (id)
"""


@query("op11_lattice_dedup", LATTICE_SQL)
def op11_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.embedding_duplicates(table(spark, sf_dir, "embeddings"))
