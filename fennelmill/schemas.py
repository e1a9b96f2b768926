"""Explicit schemas of every feed, document and state table, as DDL: a module can be imported without a session."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str | T.StructType) -> T.StructType:
    """A schema from its DDL; a session has to be there."""
    return T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl


#: A feed's items are arrays in one document; order in the array is kept as ``pos``.
CATALOGUE_A_ITEM = "item_id STRING, title STRING, price BIGINT, features ARRAY<STRING>, url STRING, image STRING, source STRING"
SEARCH_B_ITEM = "title STRING, price BIGINT, url STRING, image STRING, item_code STRING, review_count BIGINT, source STRING"
RANKING_B_ITEM = "rank INT, title STRING, price BIGINT, url STRING, image STRING, item_code STRING, review_count BIGINT"
HITS_C_ITEM = "title STRING, price BIGINT, url STRING, image STRING, shop STRING, code STRING, jan_code STRING, review_count BIGINT, review_average DOUBLE, source STRING"
BOOK_ITEM = "title STRING, authors ARRAY<STRING>, description STRING, url STRING, image STRING"
VIDEO_ITEM = "title STRING, url STRING, thumbnail STRING"
LINK_ITEM = "title STRING, url STRING"
NEWS_ITEM = "title STRING, url STRING, published STRING"
TREND_ITEM = "query STRING, traffic STRING"

FEEDS: dict[str, str] = {
    "catalogue_a": f"keyword STRING, mode STRING, items ARRAY<STRUCT<{CATALOGUE_A_ITEM}>>",
    "search_b": f"keyword STRING, items ARRAY<STRUCT<{SEARCH_B_ITEM}>>",
    "ranking_b": f"items ARRAY<STRUCT<{RANKING_B_ITEM}>>",
    "hits_c": f"keyword STRING, total_available BIGINT, total_returned BIGINT, items ARRAY<STRUCT<{HITS_C_ITEM}>>",
    "books": f"keyword STRING, items ARRAY<STRUCT<{BOOK_ITEM}>>",
    "videos": f"items ARRAY<STRUCT<{VIDEO_ITEM}>>",
    "news": f"items ARRAY<STRUCT<{NEWS_ITEM}>>",
    "maker": f"items ARRAY<STRUCT<{LINK_ITEM}>>",
    "trends": f"top_queries ARRAY<STRUCT<{TREND_ITEM}>>",
}
#: Raw responses, as providers send them.
RESPONSE_A = (
    "items ARRAY<STRUCT<asin STRING, itemInfo STRUCT<title STRUCT<displayValue STRING>, features STRUCT<displayValues ARRAY<STRING>>>, images STRUCT<`primary` STRUCT<large STRUCT<url STRING>>>,"
    " offersV2 STRUCT<listings ARRAY<STRUCT<price STRUCT<money STRUCT<amount DOUBLE>>>>>>>"
)
_ITEM_B = "rank INT, itemName STRING, itemPrice BIGINT, affiliateUrl STRING, itemUrl STRING, mediumImageUrls ARRAY<STRUCT<imageUrl STRING>>, itemCode STRING, reviewCount BIGINT"
RESPONSE_B = f"Items ARRAY<STRUCT<Item STRUCT<{_ITEM_B}>, {_ITEM_B}>>"
RESPONSE_C = (
    "totalResultsAvailable BIGINT, totalResultsReturned BIGINT, hits ARRAY<STRUCT<name STRING, url STRING, price BIGINT, code STRING, janCode STRING,"
    " exImage STRUCT<url STRING>, image STRUCT<small STRING, medium STRING>, seller STRUCT<name STRING>, review STRUCT<count BIGINT, rate DOUBLE>>>"
)
RESPONSE_BOOKS = "items ARRAY<STRUCT<volumeInfo STRUCT<title STRING, authors ARRAY<STRING>, description STRING, infoLink STRING, imageLinks STRUCT<thumbnail STRING, smallThumbnail STRING>>>>"
RESPONSE_VIDEOS = "items ARRAY<STRUCT<id STRUCT<videoId STRING>, snippet STRUCT<title STRING, thumbnails STRUCT<high STRUCT<url STRING>>>>>"

#: Objects with an open set of keys are maps, never structs: inference would make a field of every key.
STATE = "history MAP<STRING, STRUCT<seen_at STRING, title STRING>>, last_rankings MAP<STRING, INT>"
HISTORY = "item_code STRING, seen_at TIMESTAMP_NTZ, title STRING"
RANKS = "item_code STRING, rank INT"
SIGNAL = "type STRING, item_code STRING, title STRING, url STRING, image STRING, price BIGINT, jump INT, score DOUBLE, branch INT, pos BIGINT"
TOPIC = "seq BIGINT, mode STRING, keyword STRING, item_id STRING"
ARTICLE_PRODUCT = "item_id STRING, name STRING, price BIGINT, link_a STRING, link_b STRING, link_c STRING, image STRING, score DOUBLE, pros ARRAY<STRING>, cons ARRAY<STRING>, features ARRAY<STRING>"
ARTICLE = (
    f"slug STRING, title STRING, meta_description STRING, date STRING, mode STRING, lead STRING, signal_type STRING, signal_type_label STRING, products ARRAY<STRUCT<{ARTICLE_PRODUCT}>>,"
    f" videos ARRAY<STRUCT<title STRING, embed STRING>>, books ARRAY<STRUCT<title STRING, url STRING, image STRING, description STRING>>, news ARRAY<STRUCT<{LINK_ITEM}>>,"
    f" maker_items ARRAY<STRUCT<{LINK_ITEM}>>, links ARRAY<STRUCT<{LINK_ITEM}>>, comment STRING, tags ARRAY<STRING>"
)
#: Under which names articles hold their videos, and videos their fields: documents of different ages differ.
DRIFTING = {"videos": (("videos", "youtube_embeds"), {"title": ("title",), "embed": ("embed", "embed_html")})}
