"""Single values: what the standard forms make of literal inputs."""

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text, urls, values
from siftwork.operators import govern, provenance
from siftwork.operators import query as q
from siftwork.plans import model
from siftwork.plans.model import Field, Plan, Requirement, Step
from siftwork.sources import fixtures, payloads, sinks


def one(spark, column, *inputs):
    return [r[0] for r in spark.createDataFrame([(x, k) for k, x in enumerate(inputs)], "v string, k int").orderBy("k").select(column(F.col("v"))).collect()]


CASES = [
    (text.clean, {"  Acme   Inc. ": "Acme Inc.", "  N/A ": None, "a b": "a b", "": None, None: None, "Not  provided": None}),
    (text.fold, {"Élan—Vital, 2": "elan vital 2", "ÀÉ": "ae", "!!": ""}),
    (urls.dataset_form, {
        "HTTPS://WWW.Acme.example/company/#team": "https://www.acme.example/company", "acme.example": "https://acme.example/", "ftp://a.example/": None, "http://A.example:80/x//?q=1": "http://a.example/x?q=1",
        "https://a_b.example/": "https://a_b.example/", "not a url": None, None: None,
    }),
    (urls.source_form, {
        "HTTPS://Example.org:443/jobs/?utm_source=search&b=2&a=1#open": "https://example.org/jobs?a=1&b=2", "https://u:p@example.org/": None, "http://localhost/": None, "https://example.org/?token=x&TOKEN=y&z=1": "https://example.org/?z=1",
        "https://example.org./a/": "https://example.org/a", "https://example.org/?a=2&b=1&a=1": "https://example.org/?a=2&a=1&b=1", "mailto:a@b.example": None,
    }),
    (urls.ranking_form, {"https://www.example.org/a/?gclid=1&token=2": "https://example.org/a?token=2"}),
    (urls.match_key, {"HTTP://www.Acme.example/Team/": "acme.example/team", "https://acme.example": "acme.example", "acme.example/TEAM": "acme.example/team"}),
    (urls.evidence_form, {"https://A.example/#x": "https://a.example", "nope": None}),
    (urls.safe_form, {"https://u:p@h.example/p?key=1&q=2#f": "https://h.example/p?q=2", "?": "[invalid-source-url]"}),
    (values.phone, {"+1 (415) 555-0100": "+14155550100", "12345": None, "0049 30 1234567": "0049301234567", "1234567890123456": None}),
    (values.number, {"1,200": 1200.0, "$1.2 million": 1200000.0, "38-52": None, "5k": 5000.0, "-3.5": -3.5, "none": None, "2 B": 2e9, "3 bananas": 3.0}),
    (values.currency, {"$1.2 million": "USD 1200000", "EUR 5": "EUR 5", "£3.50": "GBP 3.5", "7": "7", "eur $5": "EUR 5"}),
    (values.country, {"IN": "India", "in": "India", "U.S.": "United States", "germany": "Germany", "Nowhere": "Nowhere", "zz": "zz"}),
    (values.iso_date, {"2024-02-29": "2024-02-29", "2023-02-29": None, "2024-2-3": None, "2024-01-02T03:04:05+01:00": "2024-01-02T02:04:05.000Z", "2024-01-02T03:04Z": "2024-01-02T03:04:00.000Z", "Jan 2": None}),
    (payloads.json_text, {'{"a":1}': '{"a":1}', "[1": None, "text": None, " [1]": " [1]"}),
]


@pytest.mark.parametrize("column,cases", CASES, ids=[c[0].__name__ for c in CASES])
def test_forms(spark, column, cases):
    assert dict(zip(cases, one(spark, column, *cases))) == cases


def test_exact_fold(spark):
    assert one(spark, lambda c: text.fold(c, exact=True), "ﬁne ㎏ Ａ") == ["fine kg a"]


def test_snippets(spark):
    cases = [
        ("Acme AI raised money", "Acme AI", True), ("acme was founded by ai people", "Acme AI Inc.", False), ("Inc. of Acme", "Acme Inc.", True), ("", "Acme", False), (None, "Acme", False), ("x", None, False), ("a b", "a", False),
        ("The founder is Jane Doe", "doe jane", True), ("costs 12 dollars", "12", True),
    ]
    df = spark.createDataFrame(cases, "s string, v string, want boolean")
    assert [r for r in df.withColumn("got", provenance.verifies(F.col("s"), F.col("v"))).collect() if r.got != r.want] == []
    assert spark.range(1).select(provenance.verifies_any(F.lit("x foo y"), F.array(F.lit("bar"), F.lit("foo")))).first()[0]


def test_csv_cells(spark):
    cases = [("plain", "plain"), ("a,b", '"a,b"'), ('say "x"', '"say ""x"""'), ("l\nm", '"l\nm"'), ("l\rm", '"l\rm"'), (None, ""), ("", ""), (" pad ", " pad "), ("é", "é")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "v string")
    assert [r[0] for r in df.select(sinks.csv_cell(F.col("v"), "string")).collect()] == [w for _, w in cases]
    typed = spark.range(1).select(*[sinks.csv_cell(F.lit(v), t) for v, t in ((True, "boolean"), (1.0, "double"), (1.5, "double"), (float("nan"), "double"), (float("inf"), "double"))])
    assert list(typed.first()) == ["true", "1", "1.5", "", ""]


def test_plan_and_requirement():
    plan = Plan((Field("company_name", required=True), Field("website", format="uri"), Field("tags", "array"), Field("n", "integer", label="Head Count")), steps=(Step("a", "EXTRACT"), Step("b", "SAVE", ("a",))))
    assert plan.problems() == [] and plan.names()["headcount"] == "n" and plan.names()["business"] == "company_name" and len(plan.digest()) == 64
    assert [f.stored_type for f in plan.fields] == ["STRING", "URL", "JSON", "NUMBER"]
    bad = Plan((Field("a"), Field("a")), steps=(Step("x", "EXTRACT", ("y",)), Step("x", "CUT")), required=("z",))
    assert len(bad.problems()) == 5
    assert Requirement(("a", "b"), ("a",), ("b",)).problems() == [] and len(Requirement(("a", "b", "c"), ("a", "b"), ("b", "d")).problems()) == 3
    assert Requirement((), missing=("topic", "topic")).missing_information("x", "") == ["topic", "The kind of entity or information to collect", "At least one requested field or attribute"]
    assert Requirement(("a",)).missing_information("x", "y") == []
    assert model.name_field(plan) == "company_name" and model.name_field(Plan((Field("x"),))) is None


def test_conformance(spark):
    wanted, found = spark.createDataFrame([], "a string, b struct<c:int,d:array<struct<e:int>>>").schema, spark.createDataFrame([], "a string, b struct<c:int>, z int").schema
    assert model.conformance(wanted, found) == (["b.d.e"], ["z"])
    assert model.leaf_paths(wanted) == ["a", "b.c", "b.d.e"]


def test_literals_and_filters():
    assert [q.literal(x) for x in ("true", "12", "1.5", "x", 3)] == [True, 12, 1.5, "x", 3]
    plan = Plan((Field("a"), Field("b", filterable=False)))
    assert q.checked_filters({"a": "1"}, plan)
    for bad in ({"b": 1}, {"c": 1}, {"a-b": 1}):
        with pytest.raises(ValueError):
            q.checked_filters(bad, plan)
    assert text.escape_like("5%_\\") == "5\\%\\_\\\\"


def test_member_guard(spark):
    members = spark.createDataFrame([(1, 2, "ACTIVE"), (1, 3, "LEFT")], "user_id int, workspace_id int, status string")
    q.require_member(members, 1, 2)
    with pytest.raises(PermissionError):
        q.require_member(members, 1, 3)


def test_fixture_counts():
    assert [fixtures.wanted_count(p) for p in ("find 40 jobs", "find 3", "999 things", "none")] == [40, 5, 100, 25]
    assert [fixtures.template(p) for p in ("hiring now", "event sponsors", "startups")] == ["job", "sponsor", "company"]


def test_skills(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "SKILL.md").write_text("---\nname: Web Search!\ndescription: 'Finds'\n---\nBody")
    (tmp_path / "b.md").write_text("no head")
    rows = {r.slug: r for r in fixtures.skills(spark, str(tmp_path)).collect()}
    assert rows["web-search"].description == "Finds" and rows["web-search"].body == "Body" and rows[""].name is None


def test_lifecycle_and_messages(spark):
    rows = [("r", "h", 1, "DISCOVERED", None, None), ("r", "h", 2, "PROCESSING", None, None), ("r", "h", 3, "PROCESSING", None, None), ("r", "h", 4, "COLLECTED", None, "ok")]
    got = govern.lifecycle(spark.createDataFrame(rows, "run string, url_hash string, seq int, status string, code string, reason string")).first()
    assert (got.status, got.reason, got.attempts) == ("COLLECTED", "ok", 2)
    assert one(spark, govern.safe_message, "fc-0123456789abcd failed") == ["[REDACTED] failed"]


def test_insert_needs_evidence(spark):
    rows = spark.createDataFrame([(1,), (2,)], "rec_idx long")
    added, evidence = provenance.insert(rows.where("rec_idx = 1"), rows, rows)
    assert [r.rec_idx for r in added.collect()] == [2] and evidence.count() == 2
    with pytest.raises(ValueError):
        provenance.insert(rows, rows, rows.where("rec_idx = 1"))


def test_snippets_of_short_passages(spark):
    """A passage as a whole, or all its words of three characters or more, wherever they stand."""
    from siftwork.operators import provenance

    texts = {1: "so alpha betas, c", 2: "alpha", 3: "x", 4: None, 5: "a  b c", 6: "betas before alpha"}
    passages = {1: "alpha", 2: "alpha beta", 3: "pha betas, c", 4: "a  b", 5: "zz"}
    held = lambda t, p: p in t or (any(len(w) >= 3 for w in p.split()) and all(w in t for w in p.split() if len(w) >= 3))
    got = provenance.verified_pairs(spark.createDataFrame(list(texts.items()), "sid long, snippet string"), spark.createDataFrame(list(passages.items()), "vid long, value string")).collect()
    assert sorted(map(tuple, got)) == sorted((d, i) for d, t in texts.items() for i, p in passages.items() if t and held(t, p))


def test_folds_are_those_of_the_standard(spark):
    """Every character but Hangul, alone and in a word, folds natively as by the exact way."""
    chars = [chr(c) for c in range(0x21, 0x30000) if not 0xAC00 <= c <= 0xD7A3 and not 0xD800 <= c <= 0xDFFF and text._plain(chr(c)) != chr(c)]
    df = spark.createDataFrame([(f"a{c}b",) for c in chars], "raw string")
    assert df.where(~text.strip_marks(F.col("raw")).eqNullSafe(text.strip_marks(F.col("raw"), exact=True))).collect() == []


def test_countries(spark):
    """Territories count, by code and by name."""
    rows = [("PR", "Puerto Rico"), ("gl", "Greenland"), ("X.K.", "Kosovo"), ("faroe islands", "Faroe Islands"), ("TR", "Türkiye"), ("ZZ", "ZZ"), (" nowhere ", "nowhere")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r[0] == r[1] for r in df.select(values.country(F.col("raw")), "want").collect())
    assert len(values.countries()) >= 250


def test_urls_are_encoded_and_without_dots(spark):
    cases = {
        "http://h.example.com/a b/é?q=ü v": "http://h.example.com/a%20b/%C3%A9?q=%C3%BC%20v", "https://h.example.com/a/./b/../c": "https://h.example.com/a/c", "https://h.example.com/a/b/..": "https://h.example.com/a",
        "https://h.example.com/../x": "https://h.example.com/x", "https://h.example.com/%2E%2e/y/%7e": "https://h.example.com/y/%7e", "https://h.example.com/a.b/..c/😀": "https://h.example.com/a.b/..c/%F0%9F%98%80",
        "https://h.example.com/.": "https://h.example.com/", "https://h.example.com/a%20b?x='1'": "https://h.example.com/a%20b?x=%271%27",
    }
    assert one(spark, urls.dataset_form, *cases) == list(cases.values())


def test_shared_folder():
    """Only a local session may do without a shared folder; a path without a scheme is the default file system's."""
    from types import SimpleNamespace as N

    from siftwork.operators import store

    def session(folder, master, system):
        hadoop = N(hadoopConfiguration=lambda: N(get=lambda _: system))
        return N(conf=N(get=lambda _, default: folder or default), sparkContext=N(master=master, _jsc=hadoop))

    assert store.shared_folder(session(None, "local[4]", "file:///")) == store.FALLBACK
    assert store.shared_folder(session("/shared/x/", "spark://m", "hdfs://name:8020/")) == "hdfs://name:8020/shared/x"
    assert store.shared_folder(session("/shared/x", "spark://m", "file:///")) == "file:///shared/x"
    assert store.shared_folder(session("file:/shared/x", "spark://m", "hdfs://name")) == "file:///shared/x"
    assert store.shared_folder(session("s3a://b/x/", "spark://m", "hdfs://name")) == "s3a://b/x"
    with pytest.raises(RuntimeError):
        store.shared_folder(session(None, "spark://m", "file:///"))


def test_numbers_are_read_in_one_pass(spark):
    """The text's digits are taken out once for short texts and once or twice for long ones; ranges, signs and overflows stay as they were."""
    made = values.number(F.col("c"))
    text = spark.createDataFrame([("9" * 308,), ("9" * 308 + " k",), ("9" * 400,), ("1, million",), ("+.5",), ("1-2",), ("12 kbar",), ("٣",)], "c string").select(made.alias("n"))
    assert [r.n for r in text.collect()] == [float("9" * 308), None, None, 1e6, 0.5, None, 12.0, None]
    assert str(text._jdf.queryExecution().analyzed()).count("regexp_replace") <= 3


def test_alike_values_are_looked_for_once(spark, monkeypatch):
    """Values with equal words are one until the end, and what is written grows with texts and pairs, not with each snippet's runs of characters."""
    from siftwork.operators import provenance

    rows, settled = [], provenance.settled
    monkeypatch.setattr(provenance, "settled", lambda df: rows.append((out := settled(df)).count()) or out)
    snippets = spark.range(300).selectExpr("id as sid", "concat('Solar panels of extraordinary machinery: part ', id % 7, ' of the whole arrangement') as snippet")
    values = spark.range(300).selectExpr("id as vid", "case when id % 3 = 0 then concat('machinery ', id % 90) when id % 3 = 1 then 'PART 5' else concat('whole missing ', id) end as value")
    got = provenance.verified_pairs(snippets, values)
    assert got.count() == 300 * 200 == got.distinct().count() and not got.where("vid % 3 = 2").count()
    assert sum(rows) < 3000


def test_white_space_values(spark):
    snippets = spark.createDataFrame([(1, "a\t\tb"), (2, "a\tb"), (3, "x \n y")], "sid long, snippet string")
    values = spark.createDataFrame([(1, "\t\t"), (2, " \n"), (3, "\t"), (4, "a\tb"), (5, None), (6, "é é")], "vid long, value string")
    from siftwork.operators import provenance

    assert sorted(map(tuple, provenance.verified_pairs(snippets, values).collect())) == [(1, 1), (2, 4), (3, 2)]


def test_wide_classes_are_asked_last(spark):
    """Patterns of many ranges pass over common characters by one range, and hold the same characters as before."""
    assert text._WIDE.startswith(r"(?![\x00-\x{BB}])") and text.ONE_SPACE.startswith(r"(?![\x21-\x{9F}])") and text.UNFOLDED.startswith(r"(?![\x21-\x{9F}])")
    chars = spark.range(0x30000).where("id < 55296 or id > 57343").selectExpr("cast(id as int) as id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as c")
    plain = {c for c in range(0xA0, 0x30000) if not 0xAC00 <= c <= 0xD7A3 and not 0xD800 <= c <= 0xDFFF and len(text._plain(chr(c))) > 1}
    assert plain <= {r.id for r in chars.where(F.col("c").rlike(text._WIDE)).collect()}
    for old, new in ((text.SPACE, text.ONE_SPACE), (text.UNFOLDED[text.UNFOLDED.index("(?:"):], text.UNFOLDED)):
        for c in (F.col("c"), F.concat(F.lit("a"), F.col("c"), F.lit("b")), F.concat(F.col("c"), F.lit(" b")), F.concat(F.lit("b"), F.col("c"))):
            assert chars.where(c.rlike(old) != c.rlike(new)).collect() == []


def test_http_urls_are_told_by_one_match(spark):
    """Whether a value is an http(s) URL without credentials needs none of its parts; it is told as they tell it."""
    from siftwork.operators import check

    cases = ["http://a.example", "HTTPS://A.example:80/x y?q#f", "ftp://a.example", "http://u@a.example/", "http://@a.example/", "http://[::1]/", "http:///x", "a.example", "", None, "http://a.example/\x00", "http://a.example/#\x00", "http://a.example/x\n", "https://a.example\n?b"]
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    by_parts = F.coalesce(urls.with_parts(F.col("raw"), lambda p: p.is_http & (p.user == "")), F.lit(False))
    assert df.where(check.is_http_url(F.col("raw")) != by_parts).collect() == []
    assert "transform" not in df.select(check.is_http_url(F.col("raw")))._jdf.queryExecution().optimizedPlan().toString()
