"""Fixed values that results depend on.

These lists, tables and limits must equal the catalog service's own values, so
they are stated here together, as plain text and in their natural order.
"""

from __future__ import annotations

# Fields written by storage, never part of a content hash or a diff.
STORAGE_FIELDS = [
    "_id", "created_at", "updated_at", "last_task_id", "last_scraped_at",
    "scrape_count", "data_hash", "deleted_at", "deleted_by_task",
]
# A crawl stamps this on every row; leaving it in would mark every re-run updated.
RUN_STAMP_FIELDS = ["scraped_at"]

CHANGE_TYPES = ["added", "updated", "deleted", "unchanged"]

TASK_STATUSES = [
    "pending", "queued", "started", "running",
    "completed", "failed", "retrying", "cancelled",
]
TERMINAL_STATUSES = ["completed", "failed", "cancelled"]
TRANSITIONS = {
    "pending": ["queued", "cancelled"],
    "queued": ["started", "cancelled"],
    "started": ["running", "failed", "cancelled"],
    "running": ["completed", "failed", "retrying", "cancelled"],
    "retrying": ["running", "failed", "cancelled"],
    "completed": [],
    "failed": [],
    "cancelled": [],
}

REGISTRY_STATUSES = ["active", "inactive", "deprecated"]
ACTIVITY_TYPES = ["LOGIN", "LOGOUT"]

# Payload limits in bytes.
RESULT_LIMIT = 12 * 1024 * 1024
CHANGE_SIDE_LIMIT = 4 * 1024 * 1024
CHANGE_FIELD_LIMIT = 1 * 1024 * 1024

TRUNCATED_REASON = "payload_exceeded_bson_safety_threshold"

VARIANT_CAP = 500
FIXED_TIERS = 16
COLOUR_LIMIT = 30
PROGRESS_LINES = 100
DESCRIPTION_LIMIT = 5000
ACTIVITY_TTL_DAYS = 365

# Option step headings: the first group with a matching phrase wins.
GROUP_PHRASES = [
    ("imprint", ["imprint color", "ink color", "foil color"]),
    ("napkin", ["napkin color"]),
    ("print_method", ["printing option", "print option", "print method", "imprint method",
                      "napkin type", "napkin style", "select style"]),
    ("ply_or_size", ["napkin size", "select size", "ply"]),
    ("orientation", ["orientation"]),
    ("style", ["style"]),
]
OPTION_GROUPS = ["print_method", "napkin", "imprint", "ply_or_size", "orientation", "style", "other"]
VARIANT_AXES = ["print_method", "napkin", "imprint", "ply_or_size"]

MATERIAL_WORDS = [
    "polypropylene", "vinyl", "cotton", "polyester", "paper",
    "fabric", "plastic", "linen", "cloth",
]
IMPRINT_WORDS = [
    "matte", "glossy", "deboss", "foil", "emboss", "digital", "full color", "full-color",
    "4 color", "screen", "photo", "one color", "two color", "imprint", "print",
    "front", "back", "side",
]
IMPRINT_PLACEHOLDERS = ["--please select--", "select", "choose"]
NON_SIZE_LABELS = ["price", "qty", "size", "size / qty", "material / qty", "qty / price"]

IMAGE_DENY = ["blank.png", "loader-", ".svg", "/cache/blank", "placeholder", "icon", "logo"]
IMAGE_DENY_EXTRA = ["upsells_", "guide_"]
MEDIA_DENY = [".mp4", ".webm", ".svg", "loader"]

NON_PRODUCT_PATHS = ["/page/", "/customer/", "/guides/", "/sample-product/", "/sample-products/"]
DEAL_MARKERS = ["/napkins-deals/", "/deal/"]

COUNTRY_CODES = {
    "US": "US",
    "USA": "US",
    "U.S.": "US",
    "U.S.A.": "US",
    "United States": "US",
    "United States of America": "US",
}
ALLOWED_COUNTRIES = ["US"]
US_NAMES = ["United States", "US"]

PRODUCT_HINT_FIELDS = ["name", "title", "sku", "product_id", "price"]

# The dynamic-tier export.
PRODUCT_COLUMNS = [
    "Source", "Supplier SKU", "Database Tag", "Product URL", "Product Name", "Product Subtype",
    "Category-1", "Sub-Category-1-1", "Material", "Size", "Description", "Meta Description",
    "Print methods", "Option Groups Detected", "Colors Total", "Napkin Colors", "Imprint Colors",
    "Main Image", "Gallery Images", "Has Pricing", "Minimum Order Qty",
]
VARIANT_COLUMNS = [
    "Variant Key", "Variant SKU", "Print Method", "Print Method Option ID",
    "Napkin Color", "Napkin Color Option ID", "Imprint Color", "Imprint Color Option ID",
    "Ply or Size", "Price Modifier Total", "Tier Outliers", "Sample Tiers",
]
JSON_COLUMNS = ["Variant JSON", "Product JSON"]

CHANGE_LOG_COLUMNS = [
    "change_type", "source", "product_id", "product_name", "product_key", "task_id",
    "session_id", "created_at", "added_fields", "removed_fields", "changed_fields",
]

# The fixed product sheet. The first header carries the house label of the
# deployment (a parameter); the tier pairs follow from a rule.
_SHEET_HEAD = [
    "Variant SKU", "Parent SKU", "Supplier SKU", "Source", "Active", "Primary Supplier",
    "Product Name", "Category-1", "Sub-Category-1-1", "Sub-Category-1-1-1", "Hex Color", "Fillers",
    "PMS Color Match", "Variant Type", "Print methods", "Long Description", "Country of Origin",
    "Inventory Quantity", "Inventory Location", "Material", "Size", "Location Name", "All Charges",
    "Brand", "Imprint Size", "Extra Color Run Charge", "Max Colors", "Max Included Colors",
    "Extra Stitches Charge", "Text Charges", "Imprint Color", "Rush Production Charges",
    "Setup Charge", "Running Charge", "Embroidery Upcharge for Additional stitches",
    "Minimum Order Qty",
]
_SHEET_TAIL = [
    "Part Group", "Description", "Product Bows", "Product Options", "Package Length",
    "Package Width", "Package Height", "Package Weight", "1 imprint color name",
    "1 imprint color hex", "Custom color Code", "USA Production additional cost/unit",
    "Show Separatly", "Digital Proof Request", "Artwork Type", "Print Position",
    "Optional Carabiner", "Optional Lid", "Optional Straw", "Optional Main Image",
    "Gallery Images", "Ship Point | Zip", "Sage|ESP Setup|Repeat|Additional Color Setup Charge",
    "Sage|ESP Additional Color Run Charges", "Sage|ESP Price Includes", "Sage|ESP Imprint Method",
    "Sage|ESP Imprint Location", "Sage|ESP Product Pricing Code", "Sage|ESP Item Size",
    "Sage|ESP Personalization", "ESP Imprint Colors", "Compliance Certs",
    "Sage|ESP ESP Categories", "Sage Categories", "DC Categories", "Product Type",
    "Artwork Sold Unimprinted", "Sage Additional Field Information",
    "Imprint Area And Method Note", "Hot Stamp", "Hot Stamp2", "Need Pretreat",
    "Max Imprint Colors By Print Methods", "Print Area Width", "Print Area Height",
    "Front Or Back Print Area", "Sleeve Print Area", "Neck Label Print Area", "Epoxy Dome",
    "Hot Stamp Qrg", "Patch", "Sample Sku", "Cp Label", "Usa Prod Additional Cost Unit",
    "Iron On Backing", "Stick On Backing", "Hook And Loop Backing", "Plastic Backing",
    "Button Loop", "Metallic Thread Option", "Standard Imprint Colors", "Pre Production Repeat",
    "Shipping", "Tech Sheet", "Compliance Option2", "Title", "Capacity", "Blank No Blank",
    "Dec Multi Color Imprint", "Second Location Imprint", "Packaging", "Optional Gift Box",
    "Thread Colors", "Embroidery Pricing 3d", "Optional Patches", "Optional Imprint",
    "Approximate Size", "Color Change", "Second Imprint Area", "Third Imprint Area",
    "Fourth Imprint Area", "Imprint Method", "Item Details", "Theme", "Rush Service", "Rush Time",
    "Unique Product Number", "Apparel Style", "Apparel Imprint Includes", "Additional Notes Iv",
    "Additional Notes V", "Additional Notes Vi", "Additional Notes Vii", "Additional Notes Viii",
    "Compliance Info", "Item Weight", "Table Name", "Approximate Production Time",
    "Imprint Second Position", "Imprint Second Position Care Instructions", "Fob Zip",
    "Optional Laser Engraving", "Lifestyle Image", "Second Side Imprint", "Shipping Weight",
    "Hot Stamp Foil Colors", "Flavors", "Flavors Available", "Optional Canister",
    "Product Optional Dimensions", "Print Area Printed Mints", "Second Design Wrapper Colors",
    "Individual Drop Shipping", "Optional Stock Designs", "Label Size", "Lead Time", "Refills",
    "Optional Pen Tube", "Apply To Product", "Optional Woven Patch Information",
    "Non Woven Items", "Compatable Items", "Samples Optional", "Pen Mixing Charge", "Tape Charge",
    "Setup Charges Disc Code", "Running Charge Disc Code", "Imprint Charges", "Setup Charge Text",
    "Running Charge Text", "Re Order Setup Charge", "Individual Peronalization", "Item Packaging",
    "Item Packaging Detail", "Pack Method", "Template download", "Additional Infos",
]


def tier_columns(count: int) -> list[str]:
    """``QtyBreak1, Price1, …`` for ``count`` tiers."""
    return [f"{kind}{i}" for i in range(1, max(0, count) + 1) for kind in ("QtyBreak", "Price")]


def sheet_columns(house_label: str = "Catalog SKU") -> list[str]:
    """The 206 headers of the fixed product sheet."""
    return [house_label, *_SHEET_HEAD, *tier_columns(FIXED_TIERS), *_SHEET_TAIL]


def dynamic_columns(max_tiers: int) -> list[str]:
    """The headers of the dynamic-tier export for a given widest tier list."""
    return [*PRODUCT_COLUMNS, *VARIANT_COLUMNS, *tier_columns(int(max_tiers or 0)), *JSON_COLUMNS]
