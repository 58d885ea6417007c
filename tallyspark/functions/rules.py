"""Rule tables, as data."""

# Keywords, names, tiers and their order must equal those of the system this library matches.
SEATING = {
    "executive_chairs": ["executive chair", "director chair", "manager chair", "executive seating"],
    "task_chairs": ["task chair", "office chair", "work chair", "operator chair", "ergonomic chair"],
    "visitor_chairs": ["visitor chair", "guest chair", "side chair", "reception chair"],
    "conference_chairs": ["conference chair", "meeting chair", "boardroom chair"],
    "sofas": ["sofa", "couch", "settee", "2-seater", "3-seater"],
    "lounge_seating": ["lounge", "armchair", "easy chair", "lounge chair", "breakout seating"],
}
DESKING = {
    "executive_desks": ["executive desk", "director desk", "manager desk", "executive table"],
    "workstations": ["workstation", "work desk", "office desk", "workspace", "desk system"],
    "meeting_tables": ["meeting table", "conference table", "boardroom table", "discussion table"],
    "pedestals": ["pedestal", "drawer unit", "mobile pedestal", "under desk drawer"],
    "cabinets": ["cabinet", "cupboard", "storage cabinet", "filing cabinet"],
    "lockers": ["locker", "personal storage", "staff locker"],
    "partitions": ["partition", "screen", "divider", "panel", "privacy screen"],
}
FALLBACK = [("seating", "task_chairs", ["chair", "seat", "stool", "bench"]), ("desking", "workstations", ["table", "desk"])]
PRICE_HEADERS = ["rate", "price", "amount", "total", "cost"]
SUMMARY = ["total", "subtotal", "vat", "grand total", "balance", "net total", "final total"]
MATERIALS = ["wood", "metal", "steel", "aluminum", "fabric", "leather", "plastic", "glass", "laminate"]
COLOURS = ["black", "white", "grey", "gray", "brown", "blue", "red", "green", "beige"]
IMAGE_COLUMNS = ["image", "img", "picture", "photo", "indicative"]
KNOWN_MAKERS = ["Sedus", "Narbutas", "Sokoa", "B&T", "Herman Miller", "Steelcase", "Vitra", "Knoll", "Haworth"]
TIERS = ["budgetary", "mid_range", "high_end"]
LEAD_TIME = {"budgetary": "2-3 weeks", "mid_range": "4-6 weeks", "high_end": "6-10 weeks"}
GENERATED = {
    "budgetary": (0.7, 0.9, 0.1, "B", "Budget Brand", {"seating": ["Ikea Business", "Office Depot", "Staples"], "tables": ["Ikea Business", "Office Depot", "HON"], "storage": ["Bisley", "Ikea Business", "Office Depot"], "lighting": ["Philips", "Osram", "Generic LED"]}),
    "mid_range": (1.0, 0.95, 0.05, "M", "Medium Brand", {"seating": ["Sedus", "Narbutas", "Sokoa"], "tables": ["Narbutas", "Sedus", "Vitra"], "storage": ["Bisley", "Sedus", "Steelcase"], "lighting": ["Artemide", "Flos", "Louis Poulsen"]}),
    "high_end": (1.5, 1.0, 0.1, "P", "Premium Brand", {"seating": ["Herman Miller", "Knoll", "Vitra"], "tables": ["Vitra", "Knoll", "USM"], "storage": ["USM", "Vitra", "Walter Knoll"], "lighting": ["Flos", "Artemide", "Louis Poulsen"]}),
}


def category_rules() -> list[tuple[str, str, list[str]]]:
    """(category, subcategory, keywords), first match wins."""
    return [("seating", k, v) for k, v in SEATING.items()] + [("desking", k, v) for k, v in DESKING.items()] + FALLBACK


# Header words, header variants by role, phrases outside tables, names of standard headers and product classes.
HEADER_WORDS = ["si.no", "item", "description", "qty", "unit", "rate", "amount", "price", "total", "image", "ref"]
HEADER_HITS = ["sn", "s.n", "serial", "no", "item", "#", "location", "room", "area", "zone", "image", "photo", "picture", "img", "description", "desc", "details", "product", "quantity", "qty", "units", "nos", "rate", "price", "cost", "total", "amount", "value", "supplier", "brand", "manufacturer"]
SHEET_WORDS = ["sn", "s.n", "serial", "item", "description", "desc", "quantity", "qty", "unit", "rate", "price", "amount", "total", "location", "image", "indicative", "material"]
ROLES = {
    "serial": ["s.no", "s.no.", "sl.no", "sl.no.", "serial", "serial no", "serial number", "sn", "si.no", "si.no.", "s no", "sl no", "serial no.", "serial number.", "s#", "sl#", "item no", "item number", "#", "sr.no", "sr.no.", "sr no", "sr. no.", "item #", "no", "no.", "number"],
    "location": ["location", "room", "area", "space", "zone", "section", "place", "position", "room name", "area name", "room/area", "location/room"],
    "image": ["image", "images", "photo", "photos", "picture", "pictures", "reference", "references", "ref", "img", "image reference", "indicative image", "indicative", "image ref", "photo reference", "picture reference", "img reference", "visual reference", "product image", "item image", "pic", "pics", "photograph", "thumbnail", "illustration", "figure", "diagram", "visual"],
    "description": ["description", "item description", "specification", "specifications", "item details", "details", "item detail", "item specification", "product description", "product details", "spec", "specs", "item name", "name", "product name", "item", "product", "article", "particulars", "item specifications", "product spec"],
    "quantity": ["qty", "quantity", "quantities", "qty.", "qty:", "qty :", "quantity.", "quantities.", "qty (nos)", "qty (units)", "nos", "number of units", "quantity required", "required qty", "no. of units", "no of units", "units required"],
    "unit": ["unit", "units", "uom", "unit of measure", "unit of measurement", "uom.", "unit.", "units.", "measurement unit", "measuring unit", "measure", "unit type"],
    "rate": ["rate", "unit rate", "unit price", "price", "cost", "value", "amount per unit", "rate per unit", "unit cost", "unit value", "price per unit", "cost per unit", "rate/unit", "price/unit", "cost/unit", "unit amount", "per unit", "per piece", "each", "rate each"],
    "amount": ["amount", "total", "total value", "total amount", "sum", "subtotal", "line total", "row total", "item total", "total price", "total cost", "amount total", "grand total", "value", "net amount", "line amount", "item amount", "cost total"],
    "supplier": ["supplier", "vendor", "manufacturer", "brand", "make", "origin", "source", "from", "supplied by", "manufactured by", "maker", "provider"],
    "actions": ["actions", "action", "edit", "delete", "modify", "remove", "manage", "control"],
}
UI_HEADERS = ["action", "actions", "product selection", "productselection"]
# Phrases that name one company or place are left to the caller.
NON_TABLE = ["date:", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "monday", "ref:", "reference:", "ref no:", "ref no.", "ref number", "cr no.:", "vat:", "address:", "gsm no.:", "mobile:", "mob:", "p.o box", "postal code", "cover page", "page", "terms & conditions", "terms and conditions", "general conditions", "project:", "supply", "installation", "furniture", "rehabilitation", "center", "with reference", "inquiry", "opportunity", "work on", "propose", "solutions", "kindly find", "including:", "for any further", "clarifications", "representative", "handling", "assistant", "enterprises", "we hope", "our proposal", "meeting", "looking forward", "sustainable", "business", "prices quoted", "inclusive of", "shipping", "vat 5%", "your site", "however", "any increase", "in the same", "this proposal", "price", "is strictly", "valid for", "days only", "offer is", "based on the", "quantities", "provided", "* cover", "* boq", "* general", "& condition"]
NON_TABLE_PATTERNS = ["prices quoted.*inclusive", "valid for [0-9]+ days", "based on the quantities", "proposal.*price.*valid", "inclusive of.*shipping", "vat.*%"]
NON_TABLE_PAGE = ["date", "ref.", "reference", "project", "terms", "conditions", "terms and conditions", "page", "page no", "page number", "cover", "letter", "prices quoted", "inclusive of", "shipping", "vat", "proposal", "price", "valid for", "days only", "offer", "based on", "quantities", "provided", "quoted", "are", "inclusive", "your site", "however", "any increase", "same", "strictly", "valid", "this", "is", "in", "the"]
STANDARD_HEADERS = [("item code|^code$", "Item Code"), ("item name|^name$", "Item Name"), ("item details|^details$", "Item Details"), ("additional", "Additional Information"), ("^uom$", "UOM"), ("quantity|^qty$", "Quantity"), ("rate|price", "Rate"), ("amount|total", "Amount")]
CLASSES = [("Seating", ["chair", "seating", "sofa", "bench", "stool", "seat"]), ("Desking", ["desk", "table", "workstation"]), ("Storage", ["cabinet", "storage", "shelf", "drawer"]), ("Lighting", ["lamp", "light"])]
LISTING_SKIP = ["add to", "select option", "wishlist", "cart", "home", "archives", "open submenu", "contact for price", "showing", "filter", "sort by", "page", "next", "previous", "view:", "categories", "tags", "coffee table", "accessories", "new arrivals", "desks", "chairs", "storage", "sofa"]
# What the header of a table of items has in it, the names of its fields in order of priority, and the words of repeated headers.
ITEM_HEADERS = ["si.no", "item", "description", "qty", "unit", "rate", "amount", "price", "total"]
ITEM_FIELDS = {
    "description": ["description", "item", "item description", "particulars"],
    "qty": ["qty", "quantity", "qnty"],
    "unit": ["unit", "uom"],
    "unit_rate": ["unit rate", "rate", "unit price", "price"],
    "total": ["total", "amount", "total amount"],
}
REPEATED_HEADERS = ["si.no", "item description", "qty", "unit rate"]
METHOD_BONUS = {"unstructured": 30, "layoutparser": 25, "layout_preserving": 20}
PRICE_IN_PROSE = [r"(?:Price|Cost|AED|USD|\$|€|£)\s*:?\s*(\d+(?:[.,]\d{2})?)", r"(\d+(?:[.,]\d{2})?)\s*(?:AED|USD|\$|€|£)"]
# Titles that are controls, and entries of menus that are no category.
PRODUCT_NOISE = ["open submenu", "close submenu", "toggle", "menu", "back", "search", "cart", "account", "login", "register", "checkout", "view all", "read more", "select options", "add to cart", "filter", "sort", "previous", "next"]
MENU_SKIP = ["home", "about", "contact", "blog", "news", "login", "register", "cart", "checkout", "account", "search", "menu", "close", "more", "view all", "see all", "all products", "shop", "store", "back", "close submenu", "open submenu", "reserved area", "download", "projects", "designer", "company", "history", "environment", "certifications", "showroom", "whistleblowing", "find out more", "share by", "share", "mail", "email"]
SECTION_SKIP = ["filter", "sort", "view", "showing", "page"]
# Words of materials and finishes, and the lines of a submittal's specifications.
SUBMITTAL_MATERIALS = ["wood", "metal", "fabric", "leather", "plastic", "steel", "aluminum"]
SUBMITTAL_FINISHES = ["polished", "matte", "glossy", "powder coated", "chrome"]
SUBMITTAL_LINES = ["Material: As specified", "Finish: As specified", "Material/Finish: Per manufacturer standard", "Color: As per approved sample", "Compliance: Meet relevant standards"]
# Names that are controls.
NO_MODEL = ["select options", "contact for price", "read more", "add to cart"]
