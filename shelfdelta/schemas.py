"""Table and message schemas (DDL text, usable with ``read.schema``)."""

from __future__ import annotations

AXIS = "struct<label:string,option_value_id:string>"
TIER = "struct<quantity:bigint,unit_price:double,is_sample:boolean,is_outlier:boolean>"
VARIANT = (f"struct<variant_key:string,sku:string,print_method:{AXIS},napkin_color:{AXIS},"
           f"imprint_color:{AXIS},ply_or_size:{AXIS},price_modifier_total:double,tiers:array<{TIER}>>")
OPTION = ("struct<label:string,option_value_id:string,option_id:string,price_modifier:double,"
          "swatch_image_url:string,step_label:string>")
COLOUR = ("struct<label:string,swatch_image_url:string,option_value_id:string,option_id:string,"
          "`group`:string,price_modifier:double>")

CATALOG = """source string, product_key string, payload map<string,string>, data_hash string,
 created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz,
 deleted_by_task string, last_task_id string, scrape_count bigint"""

# A stored row without its payload. ``stamps`` holds the payload fields that no hash covers, ``written`` and
# ``seen_in`` the numbers of the commits that wrote the payload and that last saw the key.
INDEX = """source string, product_key string, data_hash string, stamps map<string,string>,
 created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz,
 deleted_by_task string, last_task_id string, scrape_count bigint, written bigint, seen_in bigint"""

BODY = "product_key string, written bigint, payload map<string,string>"

CHANGES = """source string, task_id string, session_id string, change_type string,
 product_key string, product_id string, product_name string,
 new_data map<string,string>, old_data map<string,string>,
 field_changes struct<added_fields:map<string,string>,removed_fields:map<string,string>,
  changed_fields:map<string,struct<old_value:string,new_value:string>>>,
 data_hash string, old_hash string, new_hash string, created_at timestamp_ntz"""

SNAPSHOT = """run_id string, snapshot_type string, source string, product_key string,
 data_hash string, created_at timestamp_ntz"""

TASK = """id string, site string, url string, payload string, user_id string, api_key_id string,
 status string, created_at timestamp_ntz, queued_at timestamp_ntz, started_at timestamp_ntz,
 completed_at timestamp_ntz, duration_ms bigint, retries_attempted int, max_retries int,
 celery_task_id string, error_message string, priority int, tags array<string>"""

STATUS_MESSAGE = """message_type string, task_id string, status string, celery_task_id string,
 queued_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz,
 duration_ms bigint, retries_attempted int, data string, error string"""

RESULT = """task_id string, site string, url string, data string,
 metadata map<string,string>, created_at timestamp_ntz"""

ERROR = """task_id string, site string, url string, error string, retry_count int,
 created_at timestamp_ntz"""

SESSION = """session_id string, source string, task_id string, scrape_type string, status string,
 started_at timestamp_ntz, completed_at timestamp_ntz, products_found bigint,
 products_stored bigint, products_failed bigint, error string, recorded_at timestamp_ntz"""

EVENT_LOG = """source string, event_type string, task_id string, session_id string,
 details map<string,string>, timestamp timestamp_ntz"""

ACTIVITY = """user_id string, user_email string, activity_type string, ip_address string,
 user_agent string, success boolean, details string, created_at timestamp_ntz"""

REGISTRY = """site_id string, name string, base_url string, status string,
 metadata struct<description:string,version:string,author:string,tags:array<string>,
  supported_features:array<string>,rate_limit_per_minute:int,requires_javascript:boolean,
  default_timeout_seconds:int>,
 created_at timestamp_ntz, updated_at timestamp_ntz"""

# The nested product document, every field optional.
PRODUCT_DOCUMENT = f"""source string, product_url string, schema_version int, name string, title string,
 category string, subcategory string, product_sku string, sku string, product_id string, url string,
 database_tag string, product_subtype string, description string, meta_description string,
 material string, size string, base_tiers array<{TIER}>,
 pricing array<struct<print_method:string,shape:string,size:string,quantity:bigint,unit_price:double,
  qty_from:bigint,price:double>>,
 id string, variant_sku string, long_description string, product_type string, brand string,
 blueprint_id bigint, provider_id bigint, provider_name string, provider_country string,
 available boolean, price_usd double, price_cents bigint,
 price_subscription_usd double, price_subscription_cents bigint,
 min_shipping_usd double, min_shipping_cents bigint,
 color_hex string, color_label string, size_label string, sizes array<string>,
 images array<string>, image string, image_url string, print_positions array<string>, imprint_styles array<string>,
 variants array<{VARIANT}>, colors array<{COLOUR[:-1]},hex:string,pms:string>>,
 options map<string,array<struct<label:string,option_value_id:string>>>,
 min_order_qty bigint, main_image string, gallery_images array<string>, print_methods array<string>,
 option_groups_detected array<string>, discovery_source string, lastmod string,
 created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"""
