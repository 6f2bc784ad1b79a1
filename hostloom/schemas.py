"""Schemas of the tables the operators exchange, as DDL text that every reader takes."""

from __future__ import annotations

PAGE = "struct<title:string,content:string>"
HOURS = "array<struct<days:array<string>,opens:string,closes:string>>"
SPECIAL = "array<struct<`from`:string,`to`:string,closed:boolean,opens:string,closes:string>>"
BUSINESS = (
    "struct<type:string,name:string,telephone:string,email:string,price_range:string,"
    "address:struct<street:string,city:string,postcode:string,region:string,country:string>,"
    f"geo:struct<lat:double,lon:double>,opening_hours:{HOURS},special_hours:{SPECIAL},"
    "rating:struct<value:double,count:double,best:double,source:string>,closure_notice:struct<text:string,closed:boolean>,"
    "offers:array<struct<name:string,price:double,currency:string,category:string>>,features:array<string>,stars:double,source:string>"
)
ACTION = (
    "struct<id:string,name:string,description:string,intent:array<string>,"
    "input:struct<type:string,required:boolean>,url:string,endpoint:struct<url:string>>"
)

SITES = (
    f"domain string, name string, pages map<string,{PAGE}>, actions array<{ACTION}>, language string, native boolean,"
    f"content_hash string, conversion string, business {BUSINESS}, category string, status string, duplicate_of string,"
    "owner_key string, popularity_rank bigint, first_seen_at timestamp, updated_at timestamp, refreshed_at timestamp,"
    "checked_at timestamp, products_crawled_at timestamp, subpages_crawled_at timestamp, http_etag string,"
    "http_last_modified string, page_fingerprint string,"
    "ai_access struct<robots_txt:boolean,blocked:array<string>,blocks_everyone:boolean,checked_at:timestamp>, ships_to array<string>"
)
SITE_PAGES = (f"full_url string, domain string, path string, title string, content string, actions array<{ACTION}>, updated_at timestamp")
EVENTS = (
    "url string, start_date timestamp, domain string, name string, end_date timestamp, description string, venue string,"
    "city string, country string, lat double, lon double, price double, currency string, online boolean"
)
ITEMS = (
    "url string, domain string, name string, price double, currency string, price_eur double, previous_price_eur double,"
    "price_changed_at timestamp, image string, available boolean, gtin string, variant_id string, sizes array<string>,"
    "colours array<string>, size_variants map<string,string>, source string, updated_at timestamp"
)
ITEM_PRICES = ("url string, price double, currency string, price_eur double, observed_at timestamp")
SEARCHES = (
    "id bigint, query string, domains array<string>, result_count bigint, duration_ms bigint, tier string, api_key string, created_at timestamp"
)
LINK_CLICKS = ("domain string, day date, clicks bigint")
BOT_HITS = ("domain string, day date, bot string, hits bigint")
PRICE_WATCHES = (
    "id bigint, url string, target_price_eur double, last_price_eur double, last_available boolean, notify_price boolean, notify_stock boolean"
)
PAGE_WATCHES = ("id bigint, url string, watch_for string, phrase string, last_hash string, last_seen boolean, alerted_at timestamp")
SAVED_SEARCHES = ("id bigint, query string, seen array<string>, checked_at timestamp, alerted_at timestamp")
CRAWL_QUEUE = ("domain string, requested_at timestamp, done_at timestamp, outcome string")
ALERTS = ("kind string, key string, payload string, at timestamp")
BENCHMARK_CASE = ("q string, domains array<string>, tld string, category string, language string")
MAP_EXTRACT = (
    "elements array<struct<tags:map<string,string>,lat:double,lon:double,center:struct<lat:double,lon:double>>>"
)
