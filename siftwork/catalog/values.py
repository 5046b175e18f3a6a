"""Normalisation of single values, over columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.catalog import query, table
from siftwork.functions import text, urls, values
from siftwork.operators import clean
from siftwork.plans import model
from siftwork.plans.model import Field, Plan


@query("""SELECT doc_id, CASE WHEN lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) NOT IN ('', 'null', 'n/a', 'na', 'none', 'not available', 'not provided') THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS cleaned FROM documents""")
def n5_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@example.com' AS email FROM customer")
def n6_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.COM"))
    return table(spark, sf_dir, "customer").select("c_custkey", clean.text_value(raw, Field("contact_email"), Plan(())).alias("email"))


@query("""SELECT n_nationkey, CASE r WHEN 0 THEN 'Germany' WHEN 1 THEN 'United States' WHEN 2 THEN 'India' WHEN 3 THEN 'France' ELSE n_name END AS country
FROM (SELECT *, n_nationkey % 5 AS r FROM nation)""")
def n7_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("DE"), F.lit("u.s."), F.lit("india"), F.lit("FRANCE"), F.col("n_name")), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", values.country(raw).alias("country"))


_URL = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\\?[^#]*)?', {})"


@query(f"""SELECT page_id, lower({_URL.format(1)}) || '://' || lower({_URL.format(2)}) || CASE WHEN regexp_replace({_URL.format(3)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_URL.format(3)}, '/+$', '') END || {_URL.format(4)} AS website FROM pages""")
def n8_dataset_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.dataset_form(F.col("url")).alias("website"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS instant, CAST(NULL AS VARCHAR) AS bad FROM orders""")
def n9_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate"))
    day, instant = F.date_format("at", "yyyy-MM-dd"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+0200'")
    return o.select("o_orderkey", values.iso_date(day).alias("day"), values.iso_date(instant).alias("instant"), values.iso_date(F.date_format("at", "yyyy-M-'31'")).alias("bad")).withColumn("bad", F.when(F.col("bad").rlike("-(0[469]|11)-31|02-31"), F.col("bad")))


@query("""SELECT c_custkey, '+49' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone, CAST(NULL AS VARCHAR) AS short FROM customer""")
def n10_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    raw = F.concat(F.lit(" +49 ("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 4))
    return table(spark, sf_dir, "customer").select("c_custkey", values.phone(raw).alias("phone"), values.phone(F.substring(digits, 1, 6)).alias("short"))


@query("""SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS DOUBLE) * 1000000 AS millions, CAST(floor(l_extendedprice) AS DOUBLE) AS plain, CAST(NULL AS DOUBLE) AS range FROM lineitem""")
def n11_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.floor("l_quantity").cast("string"), F.floor("l_extendedprice").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", values.number(F.concat(q, F.lit(" million"))).alias("millions"), values.number(F.concat(F.lit("about "), p)).alias("plain"), values.number(F.concat(q, F.lit("-"), p)).alias("range"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'USD ' WHEN 1 THEN 'EUR ' ELSE '' END || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM orders""")
def n12_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("$"), n)).when(F.col("o_orderkey") % 3 == 1, F.concat(n, F.lit(" eur"))).otherwise(n)
    return table(spark, sf_dir, "orders").select("o_orderkey", values.currency(raw).alias("price"))


@query("""SELECT p_partkey, list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> '') AS words FROM part""")
def n15_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array_append(F.transform(F.split("p_type", " "), lambda x: F.concat(F.lit("  "), x)), F.lit(" n/a "))
    made = clean.prepared(raw, "array<string>", Field("words", "array"), Plan(()))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("words"))


PARTS = Plan((Field("company_name", required=True), Field("website"), Field("price", "number"), Field("country")), transforms=(("website", "NORMALIZE_URL"),))


@query("""SELECT s_suppkey AS rec_idx, s_name AS company_name, 'https://s' || s_suppkey || '.example.com/' AS website, floor(s_acctbal) AS price, CAST(NULL AS VARCHAR) AS country,
CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS n_notes FROM supplier""")
def n1_n3_n16_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias columns go to their fields; where two inputs differ the first stays and a note is left; absent fields are null."""
    s = table(spark, sf_dir, "supplier")
    records = s.select(
        F.col("s_suppkey").alias("rec_idx"), F.array(F.lit("https://example.com/")).alias("source_urls"), F.col("s_name").alias("Organisation"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("other")).alias("Business"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".example.com/#top")).alias("Home-Page"), F.floor("s_acctbal").cast("double").alias("price"),
    )
    out = clean.normalize(records, PARTS)
    notes = F.size(F.flatten(F.map_values("notes")))
    return out.select("rec_idx", "values.company_name", "values.website", "values.price", "values.country", notes.alias("n_notes"))


@query("""SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS folded FROM documents""")
def d2_text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("""SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)) AS match_key FROM pages""")
def d3_match_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.match_key(F.col("url")).alias("match_key"))


@query("""SELECT s_suppkey, replace(lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '', 'g')), ' ', '') AS entity FROM supplier""")
def d12_entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.operators.match import entity_name

    return table(spark, sf_dir, "supplier").select("s_suppkey", entity_name(F.concat("s_name", F.lit(", Ltd. Co"))).alias("entity"))


@query("""SELECT id, subject, CASE WHEN id = 'r5' THEN sha256(result) ELSE result END AS result FROM (VALUES ('n2', 'Café-Größe 1', 'cafegroe1'), ('n2', 'E-Mail', 'email'), ('n2', 'ﬁeld №2', 'fieldno2'),
('n13', 'company_url', 'url'), ('n13', 'founded', 'date'), ('n13', 'mobile_no', 'phone'), ('n13', 'total_cost', 'money'), ('n13', 'created_at', ''),
('n14', 'homepage', 'https://example.com/a'), ('n14', 'size', '1200'), ('d11', 'company_name,name', 'company_name'), ('d11', 'title,name', 'name'), ('d11', 'title', ''),
('v17', 'consistent', '0'), ('v17', 'repeated step, late dependency, no save, unknown key', '4'), ('v18', 'parted', '0'), ('v18', 'both, neither, foreign', '3'),
('r5', 'name', '{"fields": [{"enum": [], "filterable": true, "format": null, "key": "name", "label": "", "required": false, "type": "string"}], "match_rules": [], "policy": {"allowed": [], "blocked": [], "per_minute": 30, "preferred": []}, "required": [], "rules": [], "steps": [], "transforms": []}'),
('r11', 'nothing', 'topic|A clear objective for the requested dataset|The kind of entity or information to collect|At least one requested field or attribute'), ('r11', 'all', '')) t(id, subject, result)""")
def plan_level_n2_n13_n14_d11_v17_v18_r5_r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is decided on the driver, from plans and keys alone."""
    kinds = {"url": model.is_url_field, "date": model.is_date_field, "phone": model.is_phone_field, "money": model.is_money_field}
    keys = ("company_url", "founded", "mobile_no", "total_cost", "created_at")
    out = [("n2", k, text.fold_key(k)) for k in ("Café-Größe 1", "E-Mail", "ﬁeld №2")]
    out += [("n13", k, ",".join(n for n, test in kinds.items() if test(Field(k)))) for k in keys]
    out += [("d11", ks, model.name_field(Plan(tuple(Field(k) for k in ks.split(",")))) or "") for ks in ("company_name,name", "title,name", "title")]
    steps = (model.Step("a", "EXTRACT"), model.Step("b", "SAVE", ("a",)))
    bad = Plan((Field("x"),), rules=(model.Rule("REQUIRED", "y"),), steps=(model.Step("a", "EXTRACT", ("b",)), model.Step("a", "CHECK")))
    out += [("v17", "consistent", str(len(Plan((Field("x"),), steps=steps).problems()))), ("v17", "repeated step, late dependency, no save, unknown key", str(len(bad.problems())))]
    out += [("v18", "parted", str(len(model.Requirement(("a", "b"), ("a",), ("b",)).problems()))), ("v18", "both, neither, foreign", str(len(model.Requirement(("a", "c"), ("a",), ("a", "d")).problems())))]
    out += [("r5", "name", Plan((Field("name"),)).digest())]
    out += [("r11", "nothing", "|".join(model.Requirement((), missing=("topic",)).missing_information("", ""))), ("r11", "all", "|".join(model.Requirement(("a",)).missing_information("x", "y")))]
    plan = Plan((Field("homepage"), Field("size")), transforms=(("homepage", "NORMALIZE_URL"), ("size", "PARSE_NUMBER")))
    raw = spark.range(1).select(F.col("id").alias("rec_idx"), F.array().cast("array<string>").alias("source_urls"), F.lit("Example.com/a/").alias("homepage"), F.lit("1.2 thousand").alias("size"))
    transformed = clean.normalize(raw, plan).select(F.lit("n14").alias("id"), F.explode(F.create_map(F.lit("homepage"), "values.homepage", F.lit("size"), "values.size")).alias("subject", "result"))
    return spark.createDataFrame(out, "id string, subject string, result string").unionByName(transformed)


@query("""SELECT p_partkey, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS BOOLEAN) AS stocked, p_name AS company_name FROM part""")
def n4_absent_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that no input has are null in their own type."""
    plan = Plan((Field("company_name"), Field("email"), Field("price", "number"), Field("stocked", "boolean")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rec_idx"), F.array().cast("array<string>").alias("source_urls"), F.col("p_name").alias("company"))
    out = clean.normalize(rows, plan)
    return out.select(F.col("rec_idx").alias("p_partkey"), "values.email", "values.price", "values.stocked", "values.company_name")


@query("""SELECT * FROM (VALUES ('ﬁne', 'fine'), ('Ｆｕｌｌ Ｗｉｄｔｈ １', 'full width 1'), ('№ ½', 'no 1 2'), ('Ǆ ŉ', 'dz ʼn'), ('㎏', 'kg'), ('ﷺ', 'صلى الله عليه وسلم'), ('Crème brûlée', 'creme brulee'), ('x² ™', 'x2 tm')) t(raw, folded)""")
def d2_compatibility_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that stand for one or several others."""
    raw = spark.createDataFrame([(x,) for x in ("ﬁne", "Ｆｕｌｌ Ｗｉｄｔｈ １", "№ ½", "Ǆ ŉ", "㎏", "ﷺ", "Crème brûlée", "x² ™")], "raw string")
    return raw.select("raw", text.fold(F.col("raw")).alias("folded"))
