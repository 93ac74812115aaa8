"""Explicit schemas of the loaded and the final tables.

Every column of a final table carries a comment and a scope in its metadata:
`global` (whole life of the user or product), `time-dependent` (one day) or
`both`. The catalogue operators and the answer validation read them from there.
"""

from __future__ import annotations

from pyspark.sql import types as T

GLOBAL, DAILY, BOTH = "global", "time-dependent", "both"

STR, LONG, DBL, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
NTZ = T.TimestampNTZType()


def _field(name: str, kind: T.DataType, comment: str | None = None, scope: str | None = None) -> T.StructField:
    meta = {}
    if comment:
        meta["comment"] = f"{comment} - Scope: {scope}" if scope else comment
    if scope:
        meta["scope"] = scope
    return T.StructField(name, kind, True, meta)


USERS = T.StructType([
    _field("id", STR), _field("first_name", STR), _field("last_name", STR), _field("gender", STR),
    _field("age", LONG), _field("state", STR), _field("street_address", STR), _field("postal_code", STR),
    _field("city", STR), _field("country", STR), _field("email", STR), _field("created_at", NTZ),
])

PRODUCTS = T.StructType([
    _field("id", LONG), _field("cost", DBL), _field("category", STR), _field("name", STR),
    _field("brand", STR), _field("retail_price", DBL), _field("department", STR), _field("sku", STR),
    _field("distribution_center_id", LONG),
])

SESSION_EVENT = T.StructType([
    _field("event_type", STR), _field("product_id", LONG), _field("created_at", NTZ),
    _field("sequence_number", LONG), _field("uri", STR), _field("cost", DBL), _field("category", STR),
    _field("name", STR), _field("brand", STR), _field("department", STR),
])

EVENTS = T.StructType([
    _field("user_id", STR), _field("country", STR), _field("session_id", STR), _field("traffic_source", STR),
    _field("session_created_at", NTZ), _field("total_cost", DBL), _field("session", T.ArrayType(SESSION_EVENT)),
])

# The two brand structs hold the same fields in a different order; rows are
# stored by position, so the order belongs to the contract.
DAY_BRAND = T.StructType([
    _field("brand_name", STR, "Brand bought that day", DAILY),
    _field("category", STR, "Categories of the brand bought that day", DAILY),
    _field("product_ids", T.ArrayType(LONG), "Ids of the products bought that day", DAILY),
    _field("purchased_items", LONG, "Items of the brand bought that day", DAILY),
    _field("brand_spend", DBL, "Money spent on the brand that day", DAILY),
])

LIFE_BRAND = T.StructType([
    _field("brand_name", STR, "Brand bought", GLOBAL),
    _field("category", STR, "Categories of the brand bought", GLOBAL),
    _field("purchased_items", LONG, "Items of the brand bought so far", GLOBAL),
    _field("product_ids", T.ArrayType(LONG), "Ids of all products bought", GLOBAL),
    _field("brand_spend", DBL, "Money spent on the brand so far", GLOBAL),
])

USER_AGGREGATES = T.StructType([
    _field("user_id", STR, "User id", GLOBAL),
    _field("age", LONG, "Age in years", GLOBAL),
    _field("gender", STR, "M or F", GLOBAL),
    _field("country", STR, "Country the user lives in", GLOBAL),
    _field("total_purchased_items", LONG, "Items bought so far, all brands", GLOBAL),
    _field("total_spend", DBL, "Money spent so far, all brands", GLOBAL),
    _field("first_purchase_date", NTZ, "First purchase, any brand", GLOBAL),
    _field("last_purchase_date", NTZ, "Latest purchase, any brand", GLOBAL),
    _field("session_day", NTZ, "Day the daily columns refer to; filter on it for any date range", DAILY),
    _field("daily_purchased_items", LONG, "Items bought that day, all brands", DAILY),
    _field("daily_spend", DBL, "Money spent that day, all brands", DAILY),
    _field("daily_purchased_products_by_brands", T.ArrayType(DAY_BRAND), "One entry per brand bought that day", DAILY),
    _field("total_purchased_products_by_brands", T.ArrayType(LIFE_BRAND), "One entry per brand ever bought", GLOBAL),
    _field("has_abandoned_cart", BOOL, "A cart was filled after the latest purchase", GLOBAL),
])

PRODUCT_AGGREGATES = T.StructType([
    _field("product_id", LONG, "Product id", BOTH),
    _field("product_name", STR, "Product name", BOTH),
    _field("brand_name", STR, "Brand of the product", BOTH),
    _field("category", STR, "Category of the product", BOTH),
    _field("product_total_purchased_items", LONG, "Items so far", GLOBAL),
    _field("product_total_spend", DBL, "Money so far", GLOBAL),
    _field("last_product_purchase_date", NTZ, "Latest session with the product", GLOBAL),
    _field("session_day", NTZ, "Day the daily columns refer to; filter on it for any date range", DAILY),
    _field("daily_product_purchased_items", LONG, "Items that day", DAILY),
    _field("daily_product_spend", DBL, "Money that day", DAILY),
    _field("country", STR, "Country of the buyer", BOTH),
    _field("traffic_source", STR, "What brought the user to the site", BOTH),
])

QUERY_LOG = T.StructType(
    [_field(n, STR) for n in (
        "source_type", "project_id", "user", "schema", "model_used", "question", "generated_sql",
        "found_in_vector", "need_rewrite", "failure_step", "error_msg")]
    + [_field("execution_time", T.TimestampType())]
)

# One JSON reply of the answer validation.
VALIDATION_REPLY = T.StructType([
    _field("filters", T.ArrayType(T.StructType([
        _field("name", STR),
        _field("classification", STR),
        _field("columns", T.ArrayType(T.StructType([
            _field("name", STR), _field("scope", STR), _field("is_relevant", BOOL)]))),
    ]))),
    _field("reversed_question", STR),
])

TABLE_COMMENTS = {
    "user_aggregates": "One row per user and day with purchases: who the user is, what was bought that day "
                       "and what was bought so far. Use it for questions about users.",
    "product_aggregates": "One row per product, day, country and traffic source. Use it for questions about "
                          "products, brands and categories.",
}


def of_table(name: str) -> T.StructType | None:
    """The described schema of a stored table; None for intermediate ones."""
    return {"events": EVENTS, "user_aggregates": USER_AGGREGATES, "product_aggregates": PRODUCT_AGGREGATES}.get(name)
