"""One registered query per operator, over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesight.llm import cross_tokenizer, decontamination, line_dedup, mixing, near_duplicates, pseudonyms, quality_classifier, quality_rules, ranked_search, sharding, suffix_dedup, token_output, url_filter
from lakesight.session import materialise, scratch_folder

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
PSEUDONYM_KEY = "key of the registered query"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.verdicts(_table(spark, folder, "documents"))
    return found.select(F.col("_doc").alias("doc_id"), *quality_rules.BASE, "n_removed_words", "kept")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_benchmark_passages(docs, _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"), "contaminated")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    spans = suffix_dedup.repeated_spans(_table(spark, folder, "documents"))
    text = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
    return spans.select("doc_id", "n_repeated", "n_removed", text("spans").alias("spans"), text("removed").alias("removed"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template")


def op6_token_output(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_folder(spark)
    token_output.write_tokens(_table(spark, folder, "documents"), files, public_tokenizers.path(TOKENIZER))
    return token_output.read_documents(spark, files)


def op7_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY).select("doc_id", "n_pseudonyms", "pseudonymised")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, folder, "documents"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return sharding.assigned(docs).select("doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_documents")


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op11_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality_classifier.classify(docs, _table(spark, folder, "labels").select("doc_id", "quality"))


def op12_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return cross_tokenizer.scored(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    index = materialise(ranked_search.build_index(docs))
    return ranked_search.search(docs, index, _table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_decontamination, op3_line_dedup, op4_suffix_dedup, op5_url_filter, op6_token_output, op7_pseudonyms,
    op8_mixing, op9_sharding, op10_near_duplicates, op11_quality_classifier, op12_cross_tokenizer,
    op13_ranked_search)}

_S = r"\x20\x09-\x0D"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


URL_LEVELS = 12  # SQL needs a fixed number; it is the same tree as long as no deeper node has MIN_SUPPORT pages


def _url_levels() -> str:
    """The template tree, one group of steps per level."""
    out = []
    for i in range(URL_LEVELS):
        out.append(f"""
  c{i} AS (SELECT host, template, segs[{i + 1}] AS seg, sum(n) AS n, sum(labelled) AS l, sum(blocked) AS b
      FROM t{i} WHERE len(segs) > {i} GROUP BY ALL),
  p{i} AS (SELECT host, template, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM c{i} GROUP BY ALL),
  b{i} AS (SELECT c.host, c.template, seg, CASE WHEN c.l > 0 AND p.l > c.l AND p.b > 0 AND p.b < p.l AND
        pow(c.b / c.l - (p.b - c.b) / (p.l - c.l), 2) > {url_filter.CRITICAL} * (p.b / p.l * (1 - p.b / p.l) * (1 / c.l + 1 / (p.l - c.l)))
        THEN seg ELSE '~' END AS branch
      FROM c{i} c JOIN p{i} p ON c.host = p.host AND c.template = p.template
      WHERE c.n >= {url_filter.MIN_SUPPORT}),
  t{i + 1} AS (SELECT t.* EXCLUDE (template), CASE WHEN len(segs) > {i} THEN t.template || '/' || coalesce(branch, {_wildcard(f'segs[{i + 1}]')})
        ELSE t.template END AS template
      FROM t{i} t LEFT JOIN b{i} b ON t.host = b.host AND t.template = b.template AND segs[{i + 1}] = seg),""")
    return "".join(out)


def _wildcard(seg: str) -> str:
    name, extension = (rf"regexp_extract({seg}, '^(.*?)(\.[A-Za-z0-9]+)?$', {g})" for g in (1, 2))
    return (f"CASE WHEN {seg} = '' THEN '' WHEN regexp_matches({name}, '^[0-9]+$') THEN '<n>' WHEN regexp_matches({name}, '[0-9]') THEN '<m>' "
            f"ELSE '<w>' END || {extension}")


def _rule_case(value) -> str:
    cases = []
    for r in sorted(url_filter.RULES, key=lambda r: -len(r.text)):
        host, slash, rest = r.text.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}') THEN '{value(r)}'")
    return f"CASE {' '.join(cases)} END"


ORACLE = {
    "op1_quality_rules": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source,
        regexp_extract_all(coalesce(text, ''), '[^{_S}]+') AS w FROM documents),
  u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
  g AS (SELECT r, i, CASE WHEN lead(x, 2) OVER o IS NOT NULL THEN x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o END AS win
      FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
  k AS (SELECT r, i, CASE WHEN win IS NOT NULL THEN count(*) OVER (PARTITION BY r, win) END AS n FROM g),
  f AS (SELECT r, coalesce(max(n) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) > 1 AS twice FROM k),
  rep AS (SELECT r, count(*) FILTER (twice) AS n FROM f GROUP BY r),
  raw AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
  norm AS (SELECT r, source, t, trim(regexp_replace(regexp_replace(lower(line), '[{_S}]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS line FROM raw),
  lines AS (SELECT *, len(regexp_extract_all(line, '[^{_S}]+')) AS n FROM norm WHERE line <> ''),
  hosts AS (SELECT source, count(DISTINCT t) AS docs FROM lines GROUP BY source),
  above AS (SELECT l.source, line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line
      HAVING count(DISTINCT t) >= {quality_rules.MIN_LINE_DOCUMENTS} AND count(DISTINCT t) > {quality_rules.MAX_LINE_SHARE} * max(docs)),
  gone AS (SELECT r, sum(n) AS n FROM lines l JOIN above a ON l.line = a.line AND l.source IS NOT DISTINCT FROM a.source GROUP BY r),
  dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^{_S}]') GROUP BY r),
  b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      coalesce(gone.n, 0) AS n_removed_words
    FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
  j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, n_removed_words::BIGINT AS n_removed_words,
  NOT base_failed AND n_words - n_removed_words >= {quality_rules.MIN_LEFT_SHARE} * n_words AS kept FROM j""",
    "op2_decontamination": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  bp AS (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM b WHERE len(w) > 0),
  bw AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM bp),
  dp AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
  hit AS (SELECT r, p, bw.size, item_id FROM dp JOIN bw ON dp.size = bw.size AND array_to_string(dp.w[p:p + dp.size - 1], ' ') = win),
  words AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(p, p + size)) AS x FROM (SELECT DISTINCT r, p, size FROM hit)) GROUP BY r),
  items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) WHERE id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op3_line_dedup": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
  k AS (SELECT *, translate(regexp_replace(line, '^[{_S}]+|[{_S}]+$', '', 'g'), {_LOWER}) AS key FROM l),
  often AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
  j AS (SELECT k.*, top IS NULL OR doc_id IS NULL OR doc_id = top AS stays FROM k LEFT JOIN often USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM j GROUP BY r""",
    "op4_suffix_dedup": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_S}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
  p AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + {suffix_dedup.LENGTH}], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {suffix_dedup.LENGTH - 1}, 0))) AS i FROM d)),
  m AS (SELECT h, min(doc_id) AS keeper FROM p GROUP BY h HAVING min(doc_id) < max(doc_id)),
  s AS (SELECT DISTINCT doc_id, i, keeper < doc_id AS later FROM p JOIN m USING (h)),
  both_ AS (SELECT doc_id, i, 'spans' AS kind FROM s UNION ALL SELECT doc_id, i, 'removed' FROM s WHERE later),
  n AS (SELECT *, CASE WHEN i <= lag(i) OVER o + {suffix_dedup.LENGTH} THEN 0 ELSE 1 END AS new FROM both_ WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind ORDER BY i) AS nr FROM n),
  sp AS (SELECT doc_id, kind, nr, min(i) AS a, max(i) + {suffix_dedup.LENGTH} AS z FROM g GROUP BY ALL)
SELECT doc_id, sum(z - a) FILTER (kind = 'spans')::BIGINT AS n_repeated, coalesce(sum(z - a) FILTER (kind = 'removed'), 0)::BIGINT AS n_removed,
  string_agg(a || '-' || z, ',' ORDER BY a) FILTER (kind = 'spans') AS spans,
  coalesce(string_agg(a || '-' || z, ',' ORDER BY a) FILTER (kind = 'removed'), '') AS removed FROM sp GROUP BY doc_id""",
    "op5_url_filter": rf"""WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
  v AS (SELECT *, {_rule_case(lambda r: r.text)} AS rule, {_rule_case(lambda r: 'allow' if r.allow else 'block')} AS judged FROM h),
  t0 AS (SELECT host, path, count(*)::DOUBLE AS n, count(judged)::DOUBLE AS labelled, count(*) FILTER (judged = 'block')::DOUBLE AS blocked,
      CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS segs, '' AS template FROM v GROUP BY host, path),{_url_levels()}
  t AS (SELECT host, path, labelled, blocked, CASE WHEN len(segs) > {URL_LEVELS}
        THEN template || array_to_string(list_transform(segs[{URL_LEVELS + 1}:], lambda g: '/' || {_wildcard('g')}), '') ELSE template END AS template
      FROM t{URL_LEVELS}),
  s AS (SELECT host, template, sum(labelled) AS l, sum(blocked) AS b FROM t GROUP BY ALL),
  o AS (SELECT CASE WHEN sum(l) > 0 THEN sum(b) / sum(l) ELSE 0 END AS overall FROM s),
  hs AS (SELECT host, least((sum(b) + {url_filter.SMOOTHING} * any_value(overall)) / (sum(l) + {url_filter.SMOOTHING}), {url_filter.REJECT_ABOVE}) AS share
      FROM s, o GROUP BY host),
  pu AS (SELECT host, template, (b + {url_filter.SMOOTHING} * share) / (l + {url_filter.SMOOTHING}) AS purity FROM s JOIN hs USING (host))
SELECT page_id, v.host, v.path, rule, coalesce(judged, CASE WHEN purity > {url_filter.REJECT_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM v JOIN t ON v.host = t.host AND v.path = t.path JOIN pu ON pu.host = t.host AND pu.template = t.template""",
    "op8_mixing": rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{_S}]+')) AS size,
        md5({7} || '|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
  s0 AS (SELECT source, sum(size)::DOUBLE AS z FROM d GROUP BY source),
  s1 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s0),
  s2 AS (SELECT *, coalesce(sum(3 * z) OVER o, 0) AS full_before, coalesce(sum(w) OVER o, 0) AS w_before, sum(z) OVER () AS total, sum(w) OVER () AS ws
      FROM s1 WINDOW o AS (ORDER BY 3 * z / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  lam AS (SELECT (total - full_before) / (ws - w_before) AS share FROM s2 WHERE 3 * z >= w * ((total - full_before) / (ws - w_before))
      ORDER BY 3 * z / w, source LIMIT 1),
  s AS (SELECT source, z, CASE WHEN w * share > 3 * z THEN 3 * z ELSE w * share END AS target FROM s1, lam),
  p AS (SELECT d.*, z, target, round(target) AS goal,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size::BIGINT AS size, z::BIGINT AS source_size, target,
  (greatest(0, least(start + size, goal) - start) + greatest(0, least(start + size + z, goal) - start - z)
   + greatest(0, least(start + size + 2 * z, goal) - start - 2 * z))::BIGINT AS taken FROM p""",
    "op9_sharding": rf"""WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h, row_number() OVER () AS r FROM documents),
  e AS (SELECT d.*, depth, h >> ({sharding.BITS} - depth) AS node FROM d, (SELECT unnest(range(0, {sharding.BITS + 1})) AS depth)),
  f AS (SELECT depth, node, sum(n_bytes) AS bytes, count(*) AS docs FROM e GROUP BY ALL HAVING sum(n_bytes) <= {sharding.LIMIT_BYTES} OR min(h) = max(h)),
  g AS (SELECT e.*, bytes, docs FROM e JOIN f USING (depth, node) QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(node), depth::INT, '0') END AS shard, depth::INT AS depth, n_bytes,
  bytes::BIGINT AS shard_bytes, docs::BIGINT AS shard_documents FROM g""",
    "op13_ranked_search": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}') AS w FROM documents),
  e AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
  st AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM e),
  b AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}')) AS t FROM benchmark),
  qt AS (SELECT q, any_value(item_id) AS item_id, t, count(*) AS times FROM b GROUP BY q, t),
  x AS (SELECT r, unnest(w) AS t FROM e),
  f AS (SELECT r, t, count(*) AS tf FROM x WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
  g AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, st GROUP BY t, big_n),
  m AS (SELECT r, doc_id, 25 + (75 * n * big_n) // big_l AS m FROM e, st),
  s AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
      sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM qt JOIN f USING (t) JOIN g USING (t) JOIN m USING (r) GROUP BY q, r),
  k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {ranked_search.TOP}""",
}
