"""Responses of the marketplaces and catalogues, normalised to feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennelmill.functions import scalars as S
from fennelmill.operators.relational import merge_by_id, unnest


def catalogue_a(response: DataFrame, source: str = "a", product_url: str = "https://shop-a.example/item/{id}?tag={tag}", tag: str = "") -> DataFrame:
    """Items of a catalogue response: features default to none, a price that is missing to 0."""
    head, tail = product_url.replace("{tag}", tag).split("{id}")
    return unnest(response, "items").select(
        "pos",
        F.col("asin").alias("item_id"),
        F.col("itemInfo.title.displayValue").alias("title"),
        S.whole_amount(S.first_of("offersV2.listings", "price", "money", "amount")).alias("price"),
        F.coalesce("itemInfo.features.displayValues", F.array().cast("array<string>")).alias("features"),
        F.concat(F.lit(head), S.text("asin"), F.lit(tail)).alias("url"),
        F.col("images.primary.large.url").alias("image"),
        F.lit(source).alias("source"),
    )


def targets_then_search(targets: DataFrame, found: DataFrame) -> DataFrame:
    """Looked-up items followed by searched items that they and earlier ones don't repeat."""
    return merge_by_id(targets, found, "item_id")


def search_term(keyword: Column, target_title: Column, default: str) -> Column:
    """What to search for: the keyword; an empty one gives the first 20 characters of the target's title, else the default."""
    return F.coalesce(S.truthy(keyword), S.truthy(S.prefix(target_title, 20)), F.lit(default))


def _image_b(images: Column) -> Column:
    return S.first_of(images, "imageUrl", default="")


def _wrapped(field: str) -> Column:
    """A field of an item that may be wrapped in another object."""
    return F.when(F.col("Item").isNotNull(), F.col(f"Item.{field}")).otherwise(F.col(field))


def _fields_b(code: Column) -> list[Column]:
    return [
        _wrapped("itemName").alias("title"),
        _wrapped("itemPrice").alias("price"),
        S.first_truthy(_wrapped("affiliateUrl"), _wrapped("itemUrl")).alias("url"),
        _image_b(_wrapped("mediumImageUrls")).alias("image"),
        code.alias("item_code"),
        F.coalesce(_wrapped("reviewCount"), F.lit(0)).alias("review_count"),
    ]


def search_b(response: DataFrame, source: str = "b") -> DataFrame:
    """Items of a search response whose elements may be wrapped; the referral URL goes first, reviews default to 0."""
    return unnest(response, "Items").select("pos", *_fields_b(F.coalesce(_wrapped("itemCode"), F.lit(""))), F.lit(source).alias("source"))


def ranking_b(response: DataFrame) -> DataFrame:
    """Ranked items; a code that is missing stays NULL."""
    return unnest(response, "Items").select("pos", _wrapped("rank").cast("int").alias("rank"), *_fields_b(_wrapped("itemCode")))


def hits_c(response: DataFrame, referral_base: str = "https://referral.example/go", referral_domain: str = "referral.example", site: str = "", partner: str = "", shop: str = "c", source: str = "c") -> DataFrame:
    """Hits with a name and a URL, with referral URLs and the best image there is."""
    hits = unnest(response, "hits").where("name <> '' and url <> ''")
    return hits.select(
        "pos",
        F.col("name").alias("title"),
        "price",
        S.referral("url", referral_base, site, partner, referral_domain).alias("url"),
        S.first_truthy("exImage.url", "image.medium", "image.small").alias("image"),
        S.first_truthy("seller.name", default=shop).alias("shop"),
        "code",
        F.col("janCode").alias("jan_code"),
        F.col("review.count").alias("review_count"),
        F.col("review.rate").alias("review_average"),
        F.lit(source).alias("source"),
    )


def books(response: DataFrame, unknown_author: str = "unknown", no_description: str = "no description") -> DataFrame:
    """Books with secure thumbnails."""
    info = "volumeInfo"
    return unnest(response, "items").select(
        "pos",
        F.col(f"{info}.title").alias("title"),
        F.coalesce(f"{info}.authors", F.array(F.lit(unknown_author))).alias("authors"),
        F.coalesce(f"{info}.description", F.lit(no_description)).alias("description"),
        F.col(f"{info}.infoLink").alias("url"),
        S.secure(S.first_truthy(f"{info}.imageLinks.thumbnail", f"{info}.imageLinks.smallThumbnail")).alias("image"),
    )


def book_query(keyword: Column, topic: str, medium: str) -> Column:
    """The keyword with the topic, unless it names it, and the medium."""
    return F.when(F.contains(keyword, F.lit(topic)), F.concat(keyword, F.lit(f" {medium}"))).otherwise(F.concat(keyword, F.lit(f" {topic} {medium}")))


def videos(response: DataFrame, watch_url: str = "https://video.example/watch?v=") -> DataFrame:
    """Videos with their watch URLs."""
    return unnest(response, "items").select("pos", F.col("snippet.title").alias("title"), F.concat(F.lit(watch_url), F.col("id.videoId")).alias("url"), F.col("snippet.thumbnails.high.url").alias("thumbnail"))
