"""Document records: JSONL scans, landed source responses, snapshots, mention facts, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_url, dedup_key, normalize_authors

SCHEMA = (
    "documentId string, sourceId string, sourceClass string, externalId string, title string, abstractText string, language string, "
    "publishedOn date, doi string, arxivId string, patentNumber string, url string, venue struct<name:string,type:string,issn:string>, "
    "authors array<struct<fullName:string,orcid:string,organizationName:string,organizationType:string,organizationCountry:string>>, "
    "topics array<struct<code:string,label:string,score:double>>, citationCount int, extraMetrics map<string,double>, dedupKey string, fetchedAt timestamp"
)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A document per line, bare or in an envelope's ``payload``; comment lines (//) and blank ones are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(//|$)"))
    bare, wrapped = F.from_json("value", SCHEMA), F.from_json("value", f"payload struct<{', '.join(x.replace(' ', ':', 1) for x in _fields())}>")["payload"]
    return lines.select(F.when(F.get_json_object("value", "$.payload").isNotNull(), wrapped).otherwise(bare).alias("d")).select("d.*").where("documentId is not null")


def _fields() -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(SCHEMA + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(SCHEMA[start:i].strip())
            start = i + 1
    return out


def derived(docs: DataFrame) -> DataFrame:
    """year, text, organizations and venue_key."""
    org = F.array_sort(F.array_distinct(F.filter(F.transform("authors", lambda a: a["organizationName"]), lambda x: x.isNotNull())))
    return docs.withColumns({
        "year": F.year("publishedOn"),
        "text": F.concat_ws(". ", "title", "abstractText"),
        "organizations": F.coalesce(org, F.array().cast("array<string>")),
        "venue_key": F.coalesce(F.col("venue.name"), F.concat(F.lit("source:"), "sourceId")),
    })


def with_dedup_key(docs: DataFrame) -> DataFrame:
    authors = normalize_authors(F.coalesce(F.transform("authors", lambda a: a["fullName"]), F.array().cast("array<string>")))
    return docs.withColumn("dedupKey", dedup_key(F.col("doi"), F.col("arxivId"), F.col("title"), authors, F.year("publishedOn")))


def first_of(page: DataFrame, keys: list[str], nth: str = "nth") -> DataFrame:
    """The first row of each key by its place in the page; rows with a null in a key all stay."""
    rest = F.min_by(F.struct(*[F.col(c) for c in page.columns]), F.struct(*[F.col(nth)])).alias("f")
    whole = page.where(" and ".join(f"{k} is not null" for k in keys))
    return whole.groupBy(*keys).agg(rest).select("f.*").unionByName(page.where(" or ".join(f"{k} is null" for k in keys)))


def new_documents(page: DataFrame, stored: DataFrame, nth: str = "nth") -> DataFrame:
    """Of a page, the first row per source id and then per dedup key, without those stored already."""
    one = first_of(first_of(page, ["sourceId", "externalId"], nth), ["dedupKey"], nth)
    return one.join(stored.select("sourceId", "externalId"), ["sourceId", "externalId"], "left_anti").join(stored.select("dedupKey"), "dedupKey", "left_anti")


def batch_counts(page: DataFrame, stored: DataFrame, nth: str = "nth") -> DataFrame:
    """One row: rows of the page, created, duplicates."""
    created = new_documents(page, stored, nth).agg(F.count("*").alias("created"))
    return page.agg(F.count("*").alias("rows")).crossJoin(created).withColumn("duplicates", F.col("rows") - F.col("created"))  # one row each


def write_snapshot(docs: DataFrame, path: str, snapshot_id: str) -> None:
    """Write-once ids, years and order of a frozen corpus."""
    rows = docs.select(F.lit(snapshot_id).alias("snapshot_id"), "documentId", F.year("publishedOn").alias("year"), F.xxhash64("documentId").alias("ordinal"))
    rows.write.mode("errorifexists").partitionBy("year").parquet(path)


def write_mentions(facts: DataFrame, path: str) -> None:
    """Append a batch of facts by month; ``read_mentions`` has the last word on a term and document."""
    facts.withColumn("month", F.date_format("published_on", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """The facts of all batches, of each term and document the one ingested last."""
    facts = spark.read.parquet(path).drop("month")
    return facts.groupBy("term_id", "document_id").agg(F.max_by(F.struct(*[F.col(c) for c in facts.columns]), F.struct("ingested_at", "occurrences")).alias("f")).select("f.*")


def upserted(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored facts after a batch: the batch's occurrences and citations win, other columns of a known fact stay."""
    keys, changed = ["term_id", "document_id"], ["occurrences", "citation_count"]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns]), F.struct("ingested_at", "occurrences")).alias("n"))
    j = stored.withColumn("o", F.struct(*[F.col(c) for c in stored.columns])).select(*keys, "o").join(last, keys, "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in changed else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
    return j.select(*keys, *[pick(c).alias(c) for c in stored.columns if c not in keys])


def added_stats(stored: DataFrame, seen: DataFrame, batch: DataFrame) -> DataFrame:
    """Document and occurrence counts by term and period after a batch: documents that were counted before are not counted again.

    ``stored``: term, period, df, tf; ``seen``: term, period, doc of earlier batches; ``batch``: term, period, doc, tf.
    """
    one = batch.groupBy("term", "period", "doc").agg(F.sum("tf").alias("tf"))
    fresh = one.join(seen.select("term", "period", "doc"), ["term", "period", "doc"], "left_anti").groupBy("term", "period").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return stored.unionByName(fresh).groupBy("term", "period").agg(F.sum("df").cast("long").alias("df"), F.sum("tf").cast("long").alias("tf"))


def save_report(report: DataFrame, path: str, report_id: str) -> None:
    """A report's ranked topics with their evidence nested; a report is written once."""
    report.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/report={report_id}")


def load_report(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    """Its topics by rank, a topic's evidence in order."""
    return spark.read.parquet(f"{path.rstrip('/')}/report={report_id}").orderBy("rank")


def read_web_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a web crawl (JSON lines url, title, text, date), one per canonical address: the first in its file. Adds canonical, day and sha256."""
    rows = spark.read.schema("url string, title string, text string, date string").json(path).withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    rows = rows.where("url is not null").withColumn("canonical", canonical_url(F.col("url")))
    first = rows.groupBy("canonical").agg(F.min_by(F.struct("url", "title", "text", "date"), F.struct("_file", "_at")).alias("f"))
    return first.select("canonical", "f.url", "f.title", "f.text", parsed_date(F.col("f.date")).alias("day"), F.sha2(F.coalesce("f.text", F.lit("")), 256).alias("sha256"))


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """The offline source: document lines of a folder."""
    return read_jsonl(spark, path).withColumn("sourceId", F.coalesce("sourceId", F.lit("fixture")))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheet of workbooks: file, row (from 1), cells (strings by column). A workbook is read by one task."""
    import io
    import re
    import zipfile
    from collections.abc import Iterator
    from xml.etree import ElementTree

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for b in batches:
            out = []
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in x.iter(f"{m}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
                    sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
                    for row in ElementTree.fromstring(z.read(sheet)).iter(f"{m}row"):
                        cells: dict[int, str] = {}
                        for c in row.iter(f"{m}c"):
                            letters = re.match("[A-Z]+", c.get("r", "A")).group()
                            at = 0
                            for x in letters:
                                at = at * 26 + ord(x) - 64
                            if c.get("t") == "inlineStr":
                                value = "".join(t.text or "" for t in c.iter(f"{m}t"))
                            else:
                                value = c.findtext(f"{m}v") or ""
                                value = shared[int(value)] if c.get("t") == "s" and value else value
                            cells[at] = value
                        out.append((file, int(row.get("r", len(out) + 1)), [cells.get(k) for k in range(1, max(cells, default=0) + 1)]))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.string()))], names=["file", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, row int, cells array<string>")


def csv_safe(x: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    s = x.cast("string")
    return F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def export_csv(report: DataFrame, path: str) -> None:
    """One file (a report has fifty topics at most), so that no part has a header only."""
    report.select(*[csv_safe(F.col(c)).alias(c) for c in report.columns]).coalesce(1).write.option("sep", ";").option("header", True).csv(path)


def export_lines(report: DataFrame) -> DataFrame:
    """A Markdown line and a JSON object for each row of a ranked report."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". **"), F.col("topic"), F.lit("** "), F.format_string("%.2f", "score"))
    return report.select("rank", line.alias("markdown"), F.to_json(F.struct("rank", "topic", "score")).alias("json"))


def brief(report: DataFrame, title: str) -> DataFrame:
    """A report (rank, topic, score, stage, evidence: array of struct title, url) as one Markdown brief: a heading, then a section per topic with its sources."""
    source = lambda e: F.concat(F.lit("- ["), F.regexp_replace(e["title"], r"([\\[\\]])", ""), F.lit("]("), e["url"], F.lit(")"))
    section = F.concat_ws("\n", F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.col("topic")), F.concat(F.lit("Score "), F.format_string("%.2f", "score"), F.lit(", "), F.lower("stage")), F.array_join(F.transform("evidence", source), "\n"))
    parts = report.agg(F.array_sort(F.collect_list(F.struct("rank", section.alias("s")))).alias("p"))  # the fifty topics of a report at most
    return parts.select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("p", lambda x: x["s"]), "\n\n")).alias("markdown"))


# Where each landed response keeps the fields of a document: rows, external id, title, abstract, date, url.
CONNECTORS = {
    "crossref": ("$.message.items", "DOI", "title[0]", "abstract", "created.date-time", "URL", "JOURNAL_ARTICLE"),
    "openalex": ("$.results", "id", "display_name", "abstract_inverted_index", "publication_date", "id", "JOURNAL_ARTICLE"),
    "europepmc": ("$.resultList.result", "id", "title", "abstractText", "firstPublicationDate", "doi", "JOURNAL_ARTICLE"),
    "semanticscholar": ("$.data", "paperId", "title", "abstract", "publicationDate", "url", "JOURNAL_ARTICLE"),
    "github": ("$.items", "full_name", "full_name", "description", "created_at", "html_url", "CODE_REPOSITORY"),
    "hackernews": ("$.hits", "objectID", "title", "story_text", "created_at", "url", "NEWS"),
    "gdelt": ("$.articles", "url", "title", "title", "seendate", "url", "NEWS"),
    "nsf": ("$.response.award", "id", "title", "abstractText", "date", "id", "NEWS"),
    "uspto": ("$.patents", "patent_id", "patent_title", "patent_abstract", "patent_date", "patent_id", "PATENT"),
    "lens": ("$.data", "lens_id", "title", "abstract", "date_published", "lens_id", "PATENT"),
    "ietf": ("$.objects", "name", "title", "abstract", "time", "resource_uri", "STANDARD"),
    "alphaxiv": ("$.papers", "universal_paper_id", "title", "abstract", "publication_date", "universal_paper_id", "PREPRINT"),
    "deepresearch": ("$.documents", "url", "title", "text", "published", "url", "NEWS"),
    "sbir": ("$.awards", "award_link", "award_title", "abstract", "proposal_award_date", "award_link", "NEWS"),
    "edgar": ("$.hits.hits", "_id", "_source.display_names[0]", "_source.file_type", "_source.file_date", "_id", "NEWS"),
}


def parsed_date(x: Column) -> Column:
    """A date of ISO, compact (20240131T…), RFC 822 or American form; null for others."""
    t = F.trim(x)
    iso = F.try_to_date(F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    compact = F.try_to_date(F.regexp_extract(t, r"^([0-9]{8})(?:T|$)", 1), "yyyyMMdd")
    mail = F.try_to_date(F.regexp_replace(F.regexp_extract(t, r"(?i)^(?:[a-z]{3},? +)?([0-9]{1,2} [a-z]{3} [0-9]{4})", 1), "^([0-9]) ", "0$1 "), "dd MMM yyyy")
    slashed = F.try_to_date(F.regexp_extract(t, r"^([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), "MM/dd/yyyy")
    return F.coalesce(iso, compact, mail, slashed)


def normalize_json(pages: DataFrame, connector: str, body: str = "body") -> DataFrame:
    """Documents of landed JSON pages of a source."""
    rows, external, title, abstract, date, url, klass = CONNECTORS[connector]
    item = F.explode(F.from_json(F.get_json_object(body, rows), "array<string>")).alias("item")
    get = lambda path: F.get_json_object("item", f"$.{path}")
    text = inverted_abstract(F.from_json(get(abstract), "map<string,array<int>>")) if abstract.endswith("inverted_index") else get(abstract)
    return pages.select(item).select(
        F.lit(connector).alias("sourceId"), F.lit(klass).alias("sourceClass"), get(external).alias("externalId"), get(title).alias("title"),
        text.alias("abstractText"), parsed_date(get(date)).alias("publishedOn"), get(url).alias("url"),
    )


def unescaped(x: Column) -> Column:
    """Without the entities of XML, and numeric ones of ASCII's marks."""
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#0?39;", "'"), ("&#x27;", "'"), ("&nbsp;|&#160;", " "), ("&amp;", "&")):
        x = F.regexp_replace(x, code, plain)
    return x


def normalize_feed(pages: DataFrame, source: str, klass: str, body: str = "body") -> DataFrame:
    """Documents of landed RSS or Atom pages (arXiv, news wires, regulators, product feeds)."""
    entry = F.explode(F.regexp_extract_all(body, F.lit(r"(?s)<(?:entry|item)[ >].*?</(?:entry|item)>"), F.lit(0))).alias("e")

    def tag(*names: str) -> Column:
        inside = lambda n: F.regexp_extract("e", f"(?s)<{n}(?: [^>]*)?>(.*?)</{n}>", 1)
        plain = lambda x: F.trim(unescaped(F.regexp_replace(x, r"<!\[CDATA\[|\]\]>", "")))
        return F.coalesce(*[F.nullif(plain(inside(n)), F.lit("")) for n in names])

    href = F.nullif(F.regexp_extract("e", r'<link[^>]*href="([^"]+)"', 1), F.lit(""))
    return pages.select(entry).select(
        F.lit(source).alias("sourceId"), F.lit(klass).alias("sourceClass"), F.coalesce(tag("id", "guid", "link"), href).alias("externalId"), tag("title").alias("title"),
        tag("summary", "description", "content").alias("abstractText"), parsed_date(tag("published", "updated", "pubDate", "dc:date")).alias("publishedOn"), F.coalesce(tag("link"), href, tag("id")).alias("url"),
    )


def inverted_abstract(index: Column, most: int = 4000) -> Column:
    """Words by place as text, from a map of words to places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.substring(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), 1, most)


def within_window(date: Column, start, end) -> Column:
    return date.between(start, end)


def accepts(klass: Column, classes: list[str]) -> Column:
    """No list accepts every class."""
    return klass.isin(classes) if classes else F.lit(True)


def high_water(docs: DataFrame, overlap_days: int = 30) -> DataFrame:
    """Per source the date to collect from next."""
    return docs.groupBy("sourceId").agg(F.date_sub(F.max("publishedOn"), overlap_days).alias("since"))


def incremental_window(cursors: DataFrame, today, days: int = 30) -> DataFrame:
    """Per source (sourceId, watermark) the window to collect: from the watermark, or ``days`` back where that is later or none is known, to today."""
    day = F.lit(today).cast("date")
    return cursors.select("sourceId", F.greatest(F.coalesce("watermark", F.date_sub(day, days)), F.date_sub(day, days)).alias("since"), day.alias("until"))


def upstream_terms(query: str, targets: list[str]) -> list[str]:
    """What a source is asked: the query itself if it has a Latin word or nothing better is known, else the direction's targets."""
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    return targets if targets and query.strip() != "*" and not any(w.isascii() and not w.isdigit() for w in words) else [query]


def robots_rules(files: DataFrame) -> DataFrame:
    """The rules of robots.txt files (host, body): host, agent, allow, path, delay (seconds; on rows without a path)."""
    from collections.abc import Iterator

    import pyarrow as pa

    def parsed(host: str, body: str) -> list[tuple]:
        out, agents, fresh = [], [], False
        for line in (body or "").splitlines():
            field, sep, value = line.split("#", 1)[0].partition(":")
            field, value = field.strip().lower(), value.strip()
            if not sep:
                continue
            if field == "user-agent":
                agents = [*(agents if fresh else []), value.lower()]
                fresh = True
                continue
            fresh = False
            if field in ("allow", "disallow"):
                out += [(host, a, field == "allow", value, None) for a in agents if value]
            elif field == "crawl-delay" and value.replace(".", "", 1).isdigit():
                out += [(host, a, None, None, float(value)) for a in agents]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.float64()]
        for b in batches:
            rows = [r for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in parsed(h, x)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "agent", "allow", "path", "delay"])

    return files.select("host", "body").mapInArrow(run, "host string, agent string, allow boolean, path string, delay double")


def allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Whether an agent may fetch each url: the longest matching rule of its own group, else of the group for all; allow wins among equals; no rule allows."""
    name = agent.split("/")[0].split(" ")[0].lower()
    host = F.regexp_extract(F.lower("url"), "^https?://([^/?#]+)", 1)
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^#]*)", 1)
    u = urls.select("url", host.alias("host"), F.when(path == "", "/").otherwise(path).alias("p")).distinct()
    own = rules.where(F.col("agent") == name).select("host").distinct().withColumn("own", F.lit(True))
    r = rules.where("path is not null").join(own, "host", "left").where(F.when(F.col("own"), F.col("agent") == name).otherwise(F.col("agent") == "*"))
    pattern = "concat('^', replace(replace(replace(replace(path, '.', '[.]'), '?', '[?]'), '+', '[+]'), '*', '.*'))"
    hit = u.join(r, "host").where(F.expr(f"p rlike {pattern}"))
    best = hit.groupBy("url").agg(F.max(F.struct(F.length("path").alias("n"), "allow")).alias("b"))
    return u.join(best, "url", "left").select("url", F.coalesce("b.allow", F.lit(True)).alias("allowed"))
