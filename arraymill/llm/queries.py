"""The corpus operators as registered queries, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_quotes, embedding_dedup, exact_dedup, filter_audit, fingerprints, license_scan, line_dedup, mixing, ngram_join, packing, suffix_dedup, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, language and id."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(_table(spark, sf_dir, "documents"), path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.ids_crc32(packing.pack(_table(spark, sf_dir, "documents"), vocabulary()))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_table(spark, sf_dir, "documents"))


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.conversations(_table(spark, sf_dir, "conversations"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(_table(spark, sf_dir, "embeddings"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_ngram_join": op7_ngram_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_chat_quotes": op9_chat_quotes,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

_NOTICES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(license_scan.TEMPLATES))
_TERM = r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"
_MARKED = f"'(?i){license_scan.MARKERS}'"
_BLANK = r"\s*"
_ABOUT = ", ".join(f"({s}, {n})" for n in range(2, license_scan.NOTICE_LINES + 1) for s in range(1 - n, 1))
OP1_SQL = f"""
WITH docs AS (
    SELECT doc_id, concat_ws('/', source, lang, doc_id || '.txt') AS path, concat_ws('/', source, lang) AS dir, coalesce(text, '') AS text FROM documents
), marked AS (
    SELECT doc_id, path, length(text) AS chars, text, string_split(text, chr(10)) AS lines,
           list_sum(list_transform(list_filter(regexp_split_to_array(text, '\n{_BLANK}\n'), lambda p: regexp_matches(p, {_MARKED})), lambda p: length(p))) AS in_marked
    FROM docs WHERE regexp_matches(text, {_MARKED})
), places AS (
    SELECT doc_id, i FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM marked) WHERE regexp_matches(lines[i + 1], {_MARKED})
), around AS (
    SELECT DISTINCT doc_id, i + s AS s, n FROM places, (VALUES {_ABOUT}) o(s, n)
), blocks AS (
    SELECT doc_id, chars, lines[s + 1 : s + n] AS block FROM around JOIN marked USING (doc_id) WHERE s >= 0 AND s + n <= len(lines)
), heads AS (
    SELECT doc_id, 'line' AS kind, trim(lines[i + 1], ' ') AS header, length(lines[i + 1]) / chars AS share FROM places JOIN marked USING (doc_id)
    UNION ALL
    SELECT doc_id, 'block', trim(array_to_string(list_transform(block, lambda x: trim(x, ' ')), ' '), ' '), 0 FROM blocks
    WHERE len(list_filter(block, lambda x: trim(x, ' ') = '' OR (length(x) > {license_scan.LINE_CHARS} AND NOT regexp_matches(x, {_MARKED})))) = 0
    UNION ALL
    SELECT doc_id, 'text', trim(text, ' '), 0 FROM marked WHERE len(lines) > 1 AND in_marked >= {license_scan.FILE_SHARE} * chars
), uniq AS (SELECT header, count(*) FILTER (kind = 'line') AS n FROM heads GROUP BY 1),
terms AS (
    SELECT header, any_value(n) AS n, term, count(*) AS tf
    FROM (SELECT header, n, unnest(regexp_extract_all(lower(header), '{_TERM}')) AS term FROM uniq) GROUP BY header, term
), total AS (SELECT coalesce(sum(n), 0) AS total FROM uniq),
df AS (SELECT term, sum(n) AS df FROM terms GROUP BY 1),
notices(t, license, notice) AS (VALUES {_NOTICES}),
nterms AS (
    SELECT t, license, term, count(*) AS tf
    FROM (SELECT t, license, unnest(regexp_extract_all(lower(notice), '{_TERM}')) AS term FROM notices) GROUP BY ALL
), w AS (SELECT header, term, tf * (ln((1 + total) / (1 + df)) + 1) AS w FROM terms JOIN df USING (term), total),
nw AS (SELECT t, license, nterms.term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS w FROM nterms LEFT JOIN df USING (term), total),
norms AS (SELECT header, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
nnorms AS (SELECT t, sqrt(sum(w * w)) AS norm FROM nw GROUP BY 1),
scores AS (
    SELECT w.header, nw.license, round(sum(w.w * nw.w) / (any_value(norms.norm) * any_value(nnorms.norm)), 6) AS score
    FROM w JOIN nw USING (term) JOIN norms ON norms.header = w.header JOIN nnorms ON nnorms.t = nw.t GROUP BY w.header, nw.t, nw.license
), best AS (
    SELECT header, license, score FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY score DESC, license) AS r FROM scores)
    WHERE r = 1 AND score >= {license_scan.THRESHOLD}
), said AS (
    SELECT doc_id, bool_or(kind = 'line' AND regexp_matches(header, '(?i){license_scan.STATED}')) AS stated,
           CASE WHEN bool_or(kind = 'text' AND license IS NOT NULL) THEN 1 ELSE sum(share) FILTER (kind = 'line') END AS share
    FROM heads LEFT JOIN best USING (header) GROUP BY doc_id
), own AS (
    SELECT doc_id, license, score FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM heads JOIN best USING (header)
    ) WHERE r = 1
), files AS (
    SELECT dir, license, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license, path) AS r
    FROM own JOIN docs USING (doc_id) JOIN said USING (doc_id) WHERE share >= {license_scan.FILE_SHARE}
), dirs AS (
    SELECT DISTINCT dir, unnest([dir, regexp_replace(dir, '/?[^/]*$', ''), '']) AS above FROM docs
), near AS (
    SELECT dirs.dir, dirs.above, license, row_number() OVER (PARTITION BY dirs.dir ORDER BY length(above) DESC) AS n
    FROM dirs JOIN files ON files.dir = dirs.above AND files.r = 1
)
SELECT d.doc_id, d.path, o.license AS own_license, o.score AS own_score,
       CASE WHEN o.license IS NULL AND NOT coalesce(stated, false) THEN near.license ELSE o.license END AS license,
       CASE WHEN o.license IS NULL AND NOT coalesce(stated, false) THEN near.above END AS inherited_from
FROM docs d LEFT JOIN own o USING (doc_id) LEFT JOIN said USING (doc_id) LEFT JOIN near ON near.dir = d.dir AND near.n = 1
"""

OP2_SQL = """
WITH texts AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM texts
), pairs AS (
    SELECT a.doc_id AS d, a.pos AS p, b.doc_id AS e, a.pos - b.pos AS shift, length(a.line) + 1 AS chars
    FROM lines a JOIN lines b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos))
), islands AS (
    SELECT *, p - row_number() OVER (PARTITION BY d, e, shift ORDER BY p) AS island FROM pairs
), runs AS (
    SELECT *, sum(chars) OVER (PARTITION BY d, e, shift, island) AS total FROM islands
), gone AS (SELECT DISTINCT d, p FROM runs WHERE total >= 50),
kept AS (
    SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
           coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.p IS NULL), '') AS t
    FROM lines l LEFT JOIN gone g ON g.d = l.doc_id AND g.p = l.pos GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, md5(t) AS kept_md5 FROM kept
"""

OP10_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(u, v) AS (
    SELECT u, v FROM pairs UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u
), counts AS (SELECT u, count(*) AS n FROM pairs GROUP BY u),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN least l ON l.u = e.vec_id
"""

OP11_SQL = """
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
kept AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT DISTINCT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN kept USING (t)
"""

OP12_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), known AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1
), masks AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
        'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(docs.doc_id > min(docs.doc_id) OVER (PARTITION BY text), false)} AS fails
    FROM docs LEFT JOIN known USING (doc_id)
), cells AS (
    SELECT part, fails.A AS a, fails.B AS b, fails.C AS c, fails.D AS d, fails.E AS e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL
), failing AS (
    SELECT *, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM cells
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
    SELECT part, filter_order, step, n, good, toxic, failed, filter_order[step] AS letter, contains(failed, filter_order[step]) AS fails,
           length(translate(failed, substr(filter_order, 1, step - 1), '')) < length(failed) AS gone
    FROM failing, orders, range(1, 6) g(step)
), figures AS (
    SELECT part, filter_order, step, letter, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
    FROM steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM figures
"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op10_embedding_dedup": OP10_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
