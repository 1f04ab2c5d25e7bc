"""What is gathered from files and reports of other tools: outputs by name, votes, ratings, archive records, URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of candidate outputs, an entry of a review page, a line of a rating report.
OUTPUT_NAME = r"^(.+)_pg(\d+)_repeat(\d+)\.md$"
ENTRY = r'<div\s+class="entry([^"]*)"\s+data-entry-id="([^"]+)"\s+data-left-metadata="([^"]+)"\s+data-right-metadata="([^"]+)"'
RATING = r"(\w+)\s+(\d+\.\d+)\s*±\s*(\d+\.\d+)\s*\[(\d+\.\d+),\s*(\d+\.\d+)\]"
IMAGES = ("image", "tiff", "jp2", "jpeg", "jpg")

RECORD = """record struct<accessRestriction:struct<status:string>, digitalObjects:array<struct<objectId:string,objectType:string,objectUrl:string>>>,
record_tag array<struct<aiMachineGenerated:boolean>>,
record_transcription array<struct<target:struct<naId:string,objectId:string,pageNum:int>,contributionType:string,contribution:string>>"""


def outputs_by_name(files: DataFrame, path: str = "path") -> DataFrame:
    """(pdf, page, repeat) of the files whose name is that of a candidate's output, beside their other columns."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    part = lambda k: F.regexp_extract(name, OUTPUT_NAME, k)
    found = files.where(name.rlike(OUTPUT_NAME))
    return found.select("*", part(1).alias("pdf"), part(2).cast("int").alias("page"), part(3).cast("int").alias("repeat"))


def _groups(text: Column, pattern: str, names: list[str]) -> Column:
    """Structs of the groups of all matches; each match is taken apart once more."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(matches, lambda m: F.struct(*[F.trim(F.regexp_extract(m, pattern, k)).alias(n) for k, n in enumerate(names, 1)]))


def review_entries(pages: DataFrame, html: str = "html") -> DataFrame:
    """(classes, entry_id, left_metadata, right_metadata) of the entries of review pages; ids have only letters, digits, - and _."""
    rows = pages.select(F.inline(_groups(F.col(html), ENTRY, ["classes", "entry_id", "left_metadata", "right_metadata"])))
    return rows.withColumn("entry_id", F.regexp_replace("entry_id", r"[^A-Za-z0-9_-]", "_"))


def votes_with_metadata(pages: DataFrame, stores: DataFrame, html: str = "html", store: str = "store") -> DataFrame:
    """Votes of JSON stores (entry id -> vote) beside what the review pages say of both sides; votes on unknown entries are dropped."""
    votes = stores.select(F.explode(F.from_json(store, "map<string,string>")).alias("entry_id", "vote"))
    return review_entries(pages, html).join(votes, "entry_id")


def ratings(reports: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, rating, error, low, high) of the lines of rating reports, beside columns to keep; other lines are left out."""
    rows = reports.select(*keep, F.inline(_groups(F.col(text), RATING, ["name", "rating", "error", "low", "high"])))
    return rows.select(*keep, "name", *[F.col(c).cast("double").alias(c) for c in ("rating", "error", "low", "high")])


def blind_sides(pairs: DataFrame, key: str, gold: str, other: str, seed: str = "") -> DataFrame:
    """``pairs`` with left, right and the side of the gold text; a hash of the key tosses the coin, so a second run tells the same."""
    left = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 1), 16, 10).cast("int") % 2 == 0
    return pairs.select("*", F.when(left, F.col(gold)).otherwise(F.col(other)).alias("left"), F.when(left, F.col(other)).otherwise(F.col(gold)).alias("right"), F.when(left, "left").otherwise("right").alias("gold_side"))


def archive_pages(records: DataFrame, json: str = "value") -> DataFrame:
    """(name, url, transcription) of the page images of archive records that may be used.

    A record must be unrestricted and have no tag that a machine made; an object an id, an address, an
    image type and a transcription aimed at it (the first counts).
    """
    rows = records.select(F.from_json(json, RECORD).alias("r")).select("r.*")
    machine = F.exists(F.coalesce("record_tag", F.array().cast("array<struct<aiMachineGenerated:boolean>>")), lambda x: F.coalesce(x["aiMachineGenerated"], F.lit(False)))
    open_ = F.coalesce(F.col("record.accessRestriction.status") == "Unrestricted", F.lit(False))
    objects = rows.where(open_ & ~machine).select(F.explode("record.digitalObjects").alias("o"), "record_transcription")
    image = F.lit(False)
    for kind in IMAGES:
        image = image | F.contains(F.lower("o.objectType"), F.lit(kind))
    objects = objects.where((F.length("o.objectId") > 0) & (F.length("o.objectUrl") > 0) & image)
    aimed = F.filter("record_transcription", lambda x: (x["contributionType"] == "Transcription") & (x["target"]["objectId"] == F.col("o.objectId")))
    first = objects.select("o", F.get(aimed, F.lit(0)).alias("t")).where("t.contribution IS NOT NULL")
    name = F.concat_ws("-", F.coalesce("t.target.naId", F.lit("")), "o.objectId", F.lit("page"), F.coalesce("t.target.pageNum", F.lit(1)).cast("string"))
    return first.select(name.alias("name"), F.col("o.objectUrl").alias("url"), F.col("t.contribution").alias("transcription"))


def plain_url(url: Column) -> Column:
    """A URL without scheme, query and fragment, its host in lower case and without a mark at its end."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    return F.regexp_replace(F.concat(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), F.regexp_replace(bare, r"^[^/]*", "")), r"/$", "")


def shared_urls(local: DataFrame, other: DataFrame, url: str = "url", origin: str = "file") -> DataFrame:
    """(url, files, origins): plain URLs that both tables name, with where each stands."""
    side = lambda df, name: df.where(F.length(url) > 0).select(plain_url(F.col(url)).alias("url"), F.col(origin).alias(name)).groupBy("url").agg(F.array_sort(F.collect_set(name)).alias(name))
    return side(local, "files").join(side(other, "origins"), "url")
