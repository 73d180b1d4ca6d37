"""A catalogue of scene files from web pages: which addresses are listed, by whom, and which pairs are whole.

    python -m jobs.product_catalogue --pages PAGES --out FOLDER [--config FILE]

pages (page_id, url, html) are pages of archives. Every page's own address and every address that it links to is
one entry of the catalogue: host, path, name (of the scene, without folders and extension), kind (radiance,
observation or other), partner (the path of the other file of a scene's pair), paired (the partner is in the
catalogue too), n_listed (pages that stand at the address), n_links and n_pages (links to it, and pages that
hold them), first_page and last_page.

Addresses are compared without query and fragment, host and scheme without regard to case, and without
scheme. Relative links are resolved against their page; links without a place (mail, script, fragments) and pages
without a host are left out.

Pages are read once and not moved: only addresses are shuffled, counted by page before they meet, so that a host
or link that a third of the pages share is counted where it is read. Entries are written by shard of their host, a shard
in `splits` files, so that a large host is not one task's. A run replaces the whole catalogue; a rerun over the same
pages gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command, settings
from plumeloom.functions.strings import granule_of, obs_path

NAME = "product_catalogue"
SCHEMA = "host string, path string, name string, kind string, partner string, paired boolean, n_listed long, n_links long, n_pages long, first_page long, last_page long, shard int"
LINK = r"<a\s[^>]*href=\"([^\"]*)\""


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(address: Column) -> Column:
    """The path, from its first stroke, without query and fragment."""
    path = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def resolved(link: Column, url: Column) -> Column:
    """The whole address of a link on the page at url; null for links without a place."""
    site = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    link = F.btrim(link)
    whole = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link))
    inside = F.when(link.startswith("/"), F.concat(site, link)).when(~link.rlike(r"^([?#]|[A-Za-z][A-Za-z0-9+.-]*:|$)"), F.concat(site, folder, link))
    return F.coalesce(whole, inside)


def addresses(pages: DataFrame) -> DataFrame:
    """host, path, page_id and whether it is the page's own address (listed)."""
    links = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.struct(resolved(x, F.col("url")).alias("address"), F.lit(False).alias("listed")))
    own = F.array(F.struct(F.col("url").alias("address"), F.lit(True).alias("listed")))
    rows = pages.filter(host_of(F.col("url")) != "").select("page_id", F.explode(F.concat(own, links)).alias("a"))
    rows = rows.select("page_id", "a.listed", host_of(F.col("a.address")).alias("host"), path_of(F.col("a.address")).alias("path"))
    return rows.filter("host <> ''")


def catalogue(pages: DataFrame, config: dict) -> DataFrame:
    by_page = addresses(pages).groupBy("host", "path", "page_id").agg(F.count_if("listed").alias("own"), F.count_if(~F.col("listed")).alias("links"))
    entries = by_page.groupBy("host", "path").agg(
        F.sum("own").alias("n_listed"), F.sum("links").alias("n_links"), F.count_if(F.col("links") > 0).alias("n_pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")
    )
    radiance, observation = F.lit(config["radiance"]), F.lit(config["observation"])
    kind = F.when(F.contains("path", radiance), "radiance").when(F.contains("path", observation), "observation").otherwise("other")
    partner = F.when(kind == "radiance", obs_path(F.col("path"))).when(kind == "observation", F.replace(F.col("path"), observation, radiance))
    entries = entries.withColumns({"name": granule_of(F.col("path")), "kind": kind, "partner": partner})
    there = entries.filter("kind <> 'other'").select("host", F.col("path").alias("partner"), F.lit(True).alias("paired"))
    pairs = entries.join(there, ["host", "partner"], "left").withColumn("paired", F.coalesce("paired", F.lit(False)))
    return pairs.withColumn("shard", F.pmod(F.crc32("host"), F.lit(config["shards"])).cast("int"))


def run(spark: SparkSession, pages: str, out: str, config: dict | None = None) -> None:
    """Read pages, replace the catalogue."""
    config = config or settings(NAME)
    table = spark.read.parquet(pages).select("page_id", "url", "html")
    entries = catalogue(table, config).withColumn("split", F.pmod(F.crc32("path"), F.lit(config["splits"])))
    entries.repartition("shard", "split").drop("split").write.mode("overwrite").partitionBy("shard").parquet(out)
    # both counts are read off the files' footers
    LOG.info("%s: read %d pages of %s, wrote %d entries to %s", NAME, table.count(), pages, read(spark, out).count(), out)


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


_ADDRESS = "'^[A-Za-z][A-Za-z0-9+.-]*://"
#: The same catalogue, with the settings beside this file.
SQL = rf"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, {_ADDRESS}([^/?#]*)', 1)) AS host, regexp_extract(url, {_ADDRESS}[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, url, 'http://' || host AS site, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') AS folder, html FROM p WHERE host <> ''),
l AS (SELECT page_id, site, folder, trim(unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)), ' ') AS link FROM q),
a AS (SELECT page_id, true AS listed, url AS address FROM q UNION ALL SELECT page_id, false, CASE WHEN regexp_matches(link, {_ADDRESS}') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN site || link WHEN NOT regexp_matches(link, '^([?#]|[A-Za-z][A-Za-z0-9+.-]*:|$)') THEN site || folder || link END FROM l),
h AS (SELECT page_id, listed, lower(regexp_extract(address, {_ADDRESS}([^/?#]*)', 1)) AS host, regexp_extract(address, {_ADDRESS}[^/?#]*([^?#]*)', 1) AS path FROM a WHERE address IS NOT NULL),
e AS (SELECT host, CASE WHEN path = '' THEN '/' ELSE path END AS path, count(*) FILTER (WHERE listed) AS n_listed, count(*) FILTER (WHERE NOT listed) AS n_links, count(DISTINCT page_id) FILTER (WHERE NOT listed) AS n_pages, min(page_id) AS first_page, max(page_id) AS last_page FROM h WHERE host <> '' GROUP BY ALL),
k AS (SELECT *, regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1) AS name, CASE WHEN contains(path, '_L1B_RAD') THEN 'radiance' WHEN contains(path, '_L1B_OBS') THEN 'observation' ELSE 'other' END AS kind FROM e),
r AS (SELECT *, CASE kind WHEN 'radiance' THEN replace(path, '_L1B_RAD', '_L1B_OBS') WHEN 'observation' THEN replace(path, '_L1B_OBS', '_L1B_RAD') END AS partner FROM k)
SELECT r.host, r.path, r.name, r.kind, r.partner, t.path IS NOT NULL AS paired, r.n_listed, r.n_links, r.n_pages, r.first_page, r.last_page FROM r LEFT JOIN r t ON t.kind <> 'other' AND t.host = r.host AND t.path = r.partner"""

if __name__ == "__main__":
    command(NAME, run, {"pages": "a table of pages (Parquet)", "out": "the catalogue's folder"})
