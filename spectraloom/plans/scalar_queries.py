"""Queries over the scalar functions and the column roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions import roles, scalars
from spectraloom.plans.registry import pick, pick_sql, query
from spectraloom.session import table

NUMBERS = ["1d", "1_000", "nan", "inf", " 12.5 ", "", "0x10", "-", "-3e2", ".5", "7.", "1e400", "12,5", None]
MARKERS = ["x", " - ", "—", "/", "NaN", "None", "n/a", "NA", "Not Reported", "0", " kept "]
HEADERS = [
    "制备工艺 | 基膜 | 截留分子量", "制备工艺 | 水相单体种类", "分离层/膜结构参数 | MWCO", "分离层/膜结构参数 | Zeta电位mV (pH=7)", "膜性能参数 | R(NaCl)", "操作参数 | 浓度（ppm）",
    "XPS参数 | HABD计算", "XPS参数 | C(%)", "N__point_count", "O__centroid_eV", "record_id", "_source_row", "Water flux L m-2 h-1 bar-1", "salt flux", "permeance flux pressure",
    "graph phase", "sometimes", "mwco", "zeta potential", "feed pressure", "monomer A", "cross-linking degree", "O2/O1 ratio", "had value", "linkage sha256", "pore size", "plain", "DOI", "test_pH", "IP_time",
]
NUMBER_SQL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


@query(rf"""
SELECT l_orderkey, l_linenumber, CAST(n AS VARCHAR) AS raw,
  CASE WHEN isfinite(v) THEN v END AS value FROM (
  SELECT *, CASE WHEN regexp_matches(n, '{NUMBER_SQL}') THEN TRY_CAST(trim(n) AS DOUBLE) END AS v FROM (
    SELECT l_orderkey, l_linenumber, coalesce({pick_sql(NUMBERS, "l_orderkey + l_linenumber")}, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS n FROM lineitem))""")
def f01_finite_double(spark, sf_dir):
    raw = F.coalesce(pick(NUMBERS, F.col("l_orderkey") + F.col("l_linenumber")), F.col("l_quantity").cast("bigint").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), scalars.finite_double(raw).alias("value"))


@query(rf"""
SELECT p_partkey, CASE WHEN lower(trim(m)) IN ('', '-', '—', '/', 'nan', 'none', 'n/a', 'na', 'not reported') THEN NULL ELSE m END AS cleaned,
  TRY_CAST(nullif(regexp_extract(p_name || ' ref 00' || p_partkey || '-9', '[0-9]+', 0), '') AS BIGINT) AS reference
FROM (SELECT *, {pick_sql(MARKERS, "p_partkey")} AS m FROM part)""")
def f02_f03_markers_and_references(spark, sf_dir):
    named = F.concat("p_name", F.lit(" ref 00"), "p_partkey", F.lit("-9"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.clean_marker(pick(MARKERS, F.col("p_partkey"))).alias("cleaned"), scalars.first_integer(named).alias("reference"))


STEMS = ["NF-{}-3-N", "ro-00{}-1-o", "NF-{}-2", "Nf-{}-12-O", "xNF-{}-1-N", "RO-{}-07-n "]


@query(r"""
SELECT s_suppkey, stem, CASE WHEN ok THEN upper(regexp_extract(stem, p, 1)) END AS dataset, CASE WHEN ok THEN CAST(regexp_extract(stem, p, 2) AS INT) END AS reference,
  CASE WHEN ok THEN CAST(regexp_extract(stem, p, 3) AS INT) END AS sample, CASE WHEN ok THEN upper(regexp_extract(stem, p, 4)) END AS element
FROM (SELECT *, '(?i)^(NF|RO)-([0-9]+)-([0-9]+)-([NO])$' AS p, regexp_matches(stem, '(?i)^(NF|RO)-([0-9]+)-([0-9]+)-([NO])$') AS ok FROM (
  SELECT s_suppkey, replace(""" + pick_sql(STEMS, "s_suppkey") + """, '{}', CAST(s_suppkey AS VARCHAR)) AS stem FROM supplier))""")
def f04_spectrum_identity(spark, sf_dir):
    stem = F.replace(pick(STEMS, F.col("s_suppkey")), F.lit("{}"), F.col("s_suppkey").cast("string"))
    named = table(spark, sf_dir, "supplier").select("s_suppkey", stem.alias("stem"))
    return named.withColumn("i", scalars.spectrum_identity("stem")).select("s_suppkey", "stem", "i.dataset", "i.reference", "i.sample", "i.element")


DOIS = ["https://doi.org/10.1038/s41467-024-{}-6.", "DOI: 10.1021/ACS.{}.b,", "http://dx.doi.org/10.99999/(x){});", "no doi {}", " 10.1/short{}", "see 10.1016/j.memsci.{} there", None]
DOI_SQL = r"nullif(regexp_replace(regexp_extract(regexp_replace(regexp_replace(lower(trim(d)), '^https?://(dx\.)?doi\.org/', ''), '^doi:\s*', ''), '10\.[0-9]{4,9}/[-._;()/:a-z0-9]+', 0), '[.,;)]+$', ''), '')"


@query(rf"""
SELECT doc_id, {DOI_SQL} AS doi,
  coalesce('doi:' || {DOI_SQL}, 'id:' || nullif(ext, ''), 'title:' || substr(sha256(lower(regexp_replace(title, '^\s+|\s+$', '', 'g'))), 1, 24)) AS doc_key,
  substr(sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source)), 1, 32) AS evidence_id
FROM (SELECT *, replace({pick_sql(DOIS, "doc_id")}, '{{}}', CAST(doc_id AS VARCHAR)) AS d, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS ext, substr(text, 1, 40) AS title FROM documents)""")
def f05_f06_f07_doi_and_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.replace(pick(DOIS, F.col("doc_id")), F.lit("{}"), F.col("doc_id").cast("string")).alias("d"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("ext"), F.substring("text", 1, 40).alias("title"),
    )
    return docs.select("doc_id", scalars.normalize_doi("d").alias("doi"), scalars.document_key("d", "ext", "title").alias("doc_key"), scalars.hash_id(F.col("doc_id").cast("string"), "lang", "source").alias("evidence_id"))


@query(r"""
SELECT page_id, regexp_replace(CASE WHEN cut = '' THEN 'document' ELSE cut END, '[ .]+$', '') AS name FROM (
  SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(' .' || url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), '\s+', ' ', 'g'), 1, 24) AS cut FROM pages)""")
def f08_safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.safe_filename(F.concat(F.lit(" ."), "url"), 24).alias("name"))


SECRETS = ["api_key=K{}&x", "Access-Token : t{}, then", "authorization: Bearer ab.{}", "bearer   tok-{} end", "plain {}"]


@query(rf"""
SELECT user_id, event_id, substr(regexp_replace(regexp_replace(e, '{scalars.CREDENTIAL}', '\1\2[REDACTED]', 'g'), '{scalars.BEARER}', 'Bearer [REDACTED]', 'g'), 1, 40) AS error
FROM (SELECT user_id, event_id, replace({pick_sql(SECRETS, "event_id")}, '{{}}', CAST(event_id AS VARCHAR)) AS e FROM events)""")
def f10_redacted_errors(spark, sf_dir):
    raw = F.replace(pick(SECRETS, F.col("event_id")), F.lit("{}"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", scalars.redacted(raw, 40).alias("error"))


@query(rf"""
SELECT grp, count(*) AS n_rows FROM (
  SELECT regexp_replace(lower(trim(g)), '{scalars.SUPPLEMENT}', '\1') AS grp FROM (
    SELECT '10.1073/PNAS.' || (l_suppkey % 9) || CASE WHEN l_linenumber = 2 THEN '/-/DCSupplemental/s1.pdf' WHEN l_linenumber = 3 THEN '/other' ELSE '' END AS g FROM lineitem))
GROUP BY grp""")
def f11_supplements_join_their_article(spark, sf_dir):
    tail = F.when(F.col("l_linenumber") == 2, "/-/DCSupplemental/s1.pdf").when(F.col("l_linenumber") == 3, "/other").otherwise("")
    raw = F.concat(F.lit("10.1073/PNAS."), F.col("l_suppkey") % 9, tail)
    return table(spark, sf_dir, "lineitem").groupBy(scalars.article_group(raw).alias("grp")).agg(F.count("*").alias("n_rows"))


#: Terms that the given documents do hold stand in for the field's.
TERMS = {"the": 5, "license": 4, "und": 3, "token": 4, "de la": 2}
TERMS_SQL = " + ".join(f"{w} * ((length(t) - length(replace(t, '{k}', ''))) // {len(k)})" for k, w in TERMS.items())


@query(f"SELECT doc_id, CAST({TERMS_SQL} AS BIGINT) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def f12_term_relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.relevance("text", TERMS).alias("score"))


WANTED = ["the", "the", "of", "license", "enchl", "Que"]


@query(f"""
SELECT doc_id, CAST(list_sum([least(4, (length(t) - length(replace(t, w, ''))) // length(w)) FOR w IN {[w.lower() for w in dict.fromkeys(WANTED) if len(w) > 2]}]) AS BIGINT) AS score
FROM (SELECT doc_id, lower(source || ' ' || text) AS t FROM documents)""")
def f13_token_relevance(spark, sf_dir):
    text = F.concat_ws(" ", "source", "text")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.token_score(text, F.array(*map(F.lit, WANTED))).alias("score"))


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{2,30}')) AS token FROM conversations) GROUP BY token")
def f14_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.explode(scalars.tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


CLAIMS = ["{} % rejection", "{}.5 LMH flux", "at {} bar⁻¹", "{} L m-2 h", "{}mL used", "sample {} only", "{} barrels"]


@query(rf"""
SELECT p_partkey, claim, regexp_matches(claim, '{scalars.UNCALIBRATED}') AS uncalibrated
FROM (SELECT p_partkey, replace({pick_sql(CLAIMS, "p_partkey")}, '{{}}', CAST(p_size AS VARCHAR)) AS claim FROM part)""")
def f15_uncalibrated_claims(spark, sf_dir):
    claim = F.replace(pick(CLAIMS, F.col("p_partkey")), F.lit("{}"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", claim.alias("claim"), scalars.uncalibrated(claim).alias("uncalibrated"))


LABELS = {"click": "running", "view": "completed", "error": "failed"}


@query(f"SELECT event_id, coalesce(map({list(LABELS)}, {list(LABELS.values())})[event_type], event_type) AS label FROM events")
def f16_status_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.looked_up(F.col("event_type"), LABELS).alias("label"))


@query("""
SELECT event_id, coalesce(strftime(TRY_CAST(t AS TIMESTAMP) + INTERVAL 8 HOUR, '%m-%d %H:%M'), 'unknown') AS shown,
  coalesce(greatest(0.0, (epoch_us(TRY_CAST(z AS TIMESTAMP)) - epoch_us(TRY_CAST(t AS TIMESTAMP))) / 1e6), 0.0) AS seconds
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t,
  CASE WHEN event_id % 7 = 0 THEN 'late' ELSE strftime(ts + (value - 20) * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S') END AS z FROM events)""")
def f17_f18_times_and_durations(spark, sf_dir):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    later = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round((F.col("value") - 20) * 60_000_000).cast("bigint"))
    times = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "soon").otherwise(iso("ts")).alias("t"), F.when(F.col("event_id") % 7 == 0, "late").otherwise(iso(later)).alias("z"))
    return times.select("event_id", scalars.local_time("t").alias("shown"), scalars.seconds_between("t", "z").alias("seconds"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN a > 0 THEN least(greatest(coalesce(b, 0), 0), a) / a END, CASE WHEN c > 0 THEN least(greatest(coalesce(d, 0), 0), c) / c END) AS ratio
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END AS a, CASE WHEN l_linenumber <> 4 THEN l_tax * 900 - 10 END AS b,
  CASE WHEN l_linenumber <> 5 THEN l_quantity END AS c, l_discount * 300 AS d FROM lineitem)""")
def f19_progress_ratio(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_linenumber") % 2 == 0, c("l_quantity")).otherwise(0.0).alias("a"), F.when(c("l_linenumber") != 4, c("l_tax") * 900 - 10).alias("b"),
        F.when(c("l_linenumber") != 5, c("l_quantity")).alias("c"), (c("l_discount") * 300).alias("d"),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", scalars.progress_ratio((c("a"), c("b")), (c("c"), c("d"))).alias("ratio"))


@query("""
SELECT event_id, coalesce(CAST(json_extract(j, '$.conditions') AS VARCHAR[]), []) AS conditions, coalesce(json_extract_string(j, '$.verification'), 'model_extracted_unreviewed') AS verification
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"conditions": ["' || event_type || '", "u' || user_id || '"]}' WHEN event_id % 3 = 1 THEN '{"verification": "checked"}' ELSE '{}' END AS j FROM events)""")
def f20_payload_defaults(spark, sf_dir):
    made = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"conditions": ["'), "event_type", F.lit('", "u'), "user_id", F.lit('"]}'))).when(F.col("event_id") % 3 == 1, '{"verification": "checked"}').otherwise("{}")
    read = F.from_json(made, "conditions array<string>, verification string")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(read["conditions"], F.array().cast("array<string>")).alias("conditions"), F.coalesce(read["verification"], F.lit("model_extracted_unreviewed")).alias("verification"))


@query("""
SELECT event_id, k AS name, v AS value FROM (
  SELECT event_id, unnest(['added', 'index.added', 'plan.pages']) AS k, unnest([CAST(event_id % 50 AS DOUBLE), CASE WHEN event_id % 4 <> 0 THEN value END, CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS DOUBLE) END]) AS v FROM events) WHERE v IS NOT NULL""")
def f21_flattened_counters(spark, sf_dir):
    made = F.to_json(
        F.struct(
            (F.col("event_id") % 50).alias("added"), F.lit("hidden").alias("path"),
            F.struct(F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("added"), F.lit("x").alias("note")).alias("index"), F.struct(F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("pages")).alias("plan"),
        )
    )
    flat = table(spark, sf_dir, "events").select("event_id", scalars.flattened_counters(made, ("added", "pages"), ("index", "text", "plan")).alias("m"))
    return flat.select("event_id", F.explode("m").alias("name", "value"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 's3a://mirror/' || substr(url, 9) ELSE url END AS path FROM pages")
def f22_path_remap(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.remapped("url", "https://", "s3a://mirror/").alias("path"))


FORMULAS = [r"$\frac{a}{b}$", r"$x_{1$", r"see $$\foo{x}$$ and $a}$", r"$\alpha + \sum_{i} x$", "$# heading$", "no formula", r"$\{a$"]


@query(f"""
SELECT issue, count(*) AS n FROM (
  SELECT CASE WHEN broken OR depth <> 0 THEN 'unbalanced' WHEN regexp_matches(f, '(?m)^\\s*(#{{1,6}}\\s|[-*+]\\s+\\*\\*)') THEN 'heading'
    WHEN len(list_filter(regexp_extract_all(f, '\\\\([A-Za-z]+)', 1), lambda x: NOT list_contains({list(scalars.MATH_COMMANDS)}, x))) > 0 THEN 'unknown command' END AS issue FROM (
    SELECT f, list_sum(list_transform(b, lambda x: CASE WHEN x = '{{' THEN 1 ELSE -1 END)) AS s, coalesce(list_sum(list_transform(b, lambda x: CASE WHEN x = '{{' THEN 1 ELSE -1 END)), 0) AS depth,
      len(list_filter(range(1, len(b) + 1), lambda i: list_sum(list_transform(b[1:i], lambda x: CASE WHEN x = '{{' THEN 1 ELSE -1 END)) < 0)) > 0 AS broken FROM (
      SELECT f, regexp_extract_all(regexp_replace(f, '\\\\[{{}}\\\\]', '', 'g'), '[{{}}]') AS b FROM (
        SELECT unnest(regexp_extract_all({pick_sql(FORMULAS, "p_partkey")}, '\\$\\$?([^$\\n]+)\\$\\$?', 1)) AS f FROM part))))
GROUP BY issue""")
def f23_formula_lint(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(F.explode(scalars.formulas(pick(FORMULAS, F.col("p_partkey")))).alias("f"))
    return found.groupBy(scalars.math_issue(F.col("f")).alias("issue")).agg(F.count("*").alias("n"))


ANSWERS = ['```json\n{"a": %}\n```', 'Sure: {"a": [%, 2]} and more', "[%, 1", '  {"b": "%"}  ', "nothing %", '```\n[%]\n```']


@query(f"""
SELECT p_partkey, replace({pick_sql(['{"a": %}', '{"a": [%, 2]}', None, '{"b": "%"}', None, '[%]'], "p_partkey")}, '%', CAST(p_size AS VARCHAR)) AS json FROM part""")
def f09_longest_json(spark, sf_dir):
    text = F.replace(pick(ANSWERS, F.col("p_partkey")), F.lit("%"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.longest_json(text).alias("json"))


H = pick_sql(HEADERS, "p_partkey")
KNOWN = f"""(lower(trim(h)) IN {roles.KNOWN_NAMES} OR len(list_intersect(regexp_split_to_array(lower(trim(h)), '[^a-z0-9]+'), {list(roles.KNOWN_WORDS)})) > 0
  OR {" OR ".join(f"contains(regexp_replace(lower(trim(h)), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '{p}')" for p in roles.KNOWN_PARTS)} OR contains(h, '交联度'))"""


@query(f"""
SELECT p_partkey, {roles.rules_sql("h", roles.COARSE, "other")} AS coarse, {roles.rules_sql("h", roles.SCIENTIFIC, "unassigned")} AS scientific,
  regexp_replace(h, '^.*?__', '') IN {roles.QUALITY} AS quality, {KNOWN} AS known,
  CASE WHEN contains(lower(h), 'flux') AND regexp_matches(lower(h), 'bar-1|bar⁻¹|/bar|mpa-1') THEN 'already pressure-normalised'
    WHEN contains(lower(h), 'flux') AND NOT contains(lower(h), 'pressure') AND NOT contains(lower(h), 'permeance') THEN 'flux or permeance' ELSE '' END AS warning
FROM (SELECT p_partkey, {H} || CASE WHEN p_size > 40 THEN ' ' || p_name ELSE '' END AS h FROM part)""")
def c06_c07_c09_c10_column_roles(spark, sf_dir):
    h = F.concat(pick(HEADERS, F.col("p_partkey")), F.when(F.col("p_size") > 40, F.concat(F.lit(" "), "p_name")).otherwise(""))
    named = table(spark, sf_dir, "part").select("p_partkey", h.alias("h"))
    return named.select("p_partkey", roles.coarse_role("h").alias("coarse"), roles.scientific_role("h").alias("scientific"), roles.is_quality("h").alias("quality"), roles.is_known_descriptor("h").alias("known"), roles.unit_warning("h").alias("warning"))


@query(f"""
SELECT p_partkey, CASE WHEN own NOT IN ('identity', 'quality') AND o IN {roles.ROLES} THEN o ELSE own END AS role FROM (
  SELECT p_partkey, CASE WHEN r = 'unassigned' AND p_size % 2 = 0 THEN 'xps' ELSE r END AS own, o FROM (
    SELECT p_partkey, p_size, {roles.rules_sql(H, roles.SCIENTIFIC, "unassigned")} AS r, CASE WHEN quality = 1 THEN 'structure' WHEN quality = 0 THEN 'nonsense' END AS o FROM part LEFT JOIN labels ON doc_id = p_partkey))""")
def c08_role_overrides(spark, sf_dir):
    """The overrides table is as large as the labels: the join is left to the optimiser, which broadcasts it when small."""
    override = F.when(F.col("quality") == 1, "structure").when(F.col("quality") == 0, "nonsense")
    both = table(spark, sf_dir, "part").join(table(spark, sf_dir, "labels"), F.col("doc_id") == F.col("p_partkey"), "left")
    return both.select("p_partkey", roles.resolved_role(roles.scientific_role(pick(HEADERS, F.col("p_partkey"))), override, F.col("p_size") % 2 == 0).alias("role"))
