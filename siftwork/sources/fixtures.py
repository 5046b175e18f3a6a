"""Sources that make their rows: demo scenarios and records by rule, and skill files."""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.plans.model import Field, MatchRule, Plan

#: Record counts of generated fixtures.
LEAST, MOST, USUAL = 5, 100, 25
#: Words of a prompt that choose a template, in order; the one without words is the rest.
TEMPLATES = {"channel": ("youtube", "channel", "video", "coding"), "company": (), "job": ("job", "role", "hiring", "salary"), "sponsor": ("sponsor", "event", "conference")}


def wanted_count(prompt: str) -> int:
    """First number of one to three digits in a prompt, within bounds."""
    m = re.search(r"\b(\d{1,3})\b", prompt)
    return min(MOST, max(LEAST, int(m[1]))) if m else USUAL


def template(prompt: str) -> str:
    words = prompt.lower()
    return next((k for k, v in TEMPLATES.items() if any(w in words for w in v)), "company")


def generated(spark: SparkSession, prompt: str) -> DataFrame:
    """Records for a prompt: rec_idx, name, website, kind, source_urls."""
    kind = template(prompt)
    n = F.format_string("%03d", F.col("id") + 1)
    site = F.concat(F.lit(f"https://{kind}-"), n, F.lit(".example.com"))
    return spark.range(wanted_count(prompt)).select(F.col("id").alias("rec_idx"), F.concat(F.lit(f"{kind.title()} "), n).alias("name"), site.alias("website"), F.lit(kind).alias("kind"), F.array(site).alias("source_urls"))


def channels(spark: SparkSession, prompt: str) -> DataFrame:
    """Records of the template of video channels: name, address, subscribers, topics, creator, description and the source that lists them, by rule."""
    k = F.col("id")
    n = F.format_string("%03d", k + 1)
    topics = F.array(*[F.lit(x) for x in ("algorithms", "web development", "systems", "data")])
    source = F.concat(F.lit("https://list-"), (k % 3).cast("string"), F.lit(".example.com/"))
    return spark.range(wanted_count(prompt)).select(
        k.alias("rec_idx"), F.concat(F.lit("Channel "), n).alias("channel_name"), F.concat(F.lit("https://video.example.com/@channel-"), n).alias("channel_url"), F.format_string("%dK", (k + 1) * 10).alias("subscribers"),
        F.element_at(topics, (k % 4 + 1).cast("int")).alias("primary_topics"), F.concat(F.lit("Creator "), n).alias("creator"), F.concat(F.lit("Verified record matching prompt criteria #"), (k + 1).cast("string")).alias("description"),
        source.alias("source_url"), F.array(source).alias("source_urls"),
    )


def domain_index(skills: DataFrame) -> DataFrame:
    """domain, slug and playbook: of the skills' playbooks (slug, playbooks: array of playbook and domains) the last that names a domain, in any case."""
    books = skills.select("slug", F.posexplode("playbooks").alias("at", "b")).select("slug", "at", F.col("b.playbook").alias("playbook"), F.explode("b.domains").alias("domain"))
    last = F.max(F.struct("slug", "at", "playbook")).alias("last")
    return books.groupBy(F.lower("domain").alias("domain")).agg(last).select("domain", "last.slug", "last.playbook")


def slug(c: Column, most: int = 64) -> Column:
    """Lower-case letters and digits joined by single hyphens."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most), "-+$", "")


def front_matter(files: DataFrame, text: str = "value") -> DataFrame:
    """``files`` with name, description, slug and body: the head between two lines of hyphens, and the rest."""
    head = F.regexp_extract(F.col(text), r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?", 1)
    value = lambda k: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1)), r"^[\"']|[\"']$", ""), F.lit(""))
    body = F.regexp_replace(F.col(text), r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    return files.withColumns({"name": value("name"), "description": value("description"), "body": body}).withColumn("slug", slug(F.coalesce("name", F.lit(""))))


def skills(spark: SparkSession, path: str) -> DataFrame:
    """Skill files below a directory: one row a file with its front matter."""
    return front_matter(spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.input_file_name()))


@dataclass(frozen=True)
class Scenario:
    """Records with seeded defects: ``repeats`` cite earlier records' key again, with values that differ; ``empty`` rows lack a required field."""

    plan: Plan
    distinct: int
    repeats: int
    empty: int
    contested: str

    @property
    def rows(self) -> int:
        return self.distinct + self.repeats + self.empty

    def records(self, spark: SparkSession) -> DataFrame:
        """Record k repeats record k - distinct from ``distinct`` on; the last ``empty`` rows are new and incomplete."""
        k = F.col("id")
        of = F.when(k.between(self.distinct, self.distinct + self.repeats - 1), k - self.distinct).otherwise(k)
        n, again = F.format_string("%03d", of + 1), of != k
        made = []
        for f in self.plan.fields:
            text = F.concat(F.lit("https://item-"), n, F.lit(".example.com/")) if f.format == "uri" else F.concat(F.lit(f"{f.key.title()} "), n)
            if f.key == self.contested:  # only the first repetition differs
                text = F.concat(F.lit("USD "), (of + F.when(again & (of == 0), 9000).otherwise(1000)).cast("string"))
            if f.required and f.format != "uri" and f.key != self.plan.fields[0].key:
                text = F.when(k >= self.distinct + self.repeats, "").otherwise(text)
            made.append(text.alias(f.key))
        site = F.concat(F.lit("https://source-"), (k % 18).cast("string"), F.lit(".example.com/"))
        return spark.range(self.rows).select(k.alias("rec_idx"), F.array(site).alias("source_urls"), *made)


#: Row counts are fixed values: 106 with 3 repeats and 1 incomplete, 32 with 2 repeats, 27 with 2 repeats.
SCENARIOS = {
    "companies": Scenario(Plan((Field("company_name", required=True), Field("founder", required=True), Field("website", format="uri"), Field("funding")), match_rules=(MatchRule(("website",)),)), 102, 3, 1, "funding"),
    "jobs": Scenario(Plan((Field("company", required=True), Field("role", required=True), Field("salary"), Field("application_url", format="uri")), match_rules=(MatchRule(("application_url",)),)), 30, 2, 0, "salary"),
    "sponsors": Scenario(Plan((Field("company_name", required=True), Field("industry"), Field("website", format="uri")), match_rules=(MatchRule(("website",)),)), 25, 2, 0, "industry"),
}
