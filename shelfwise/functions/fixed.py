"""Fixed values of the catalogue rules: word lists, patterns, weights and thresholds that results must agree with."""

#: Colour words, Norwegian and English.
COLOURS = ["hvit", "white", "svart", "black", "blå", "blue", "rød", "red", "grønn", "green", "gul", "yellow", "rosa", "pink", "lilla", "purple", "oransje", "orange", "brun", "brown", "grå", "grey", "gray", "transparent", "klar", "clear"]
#: Words without meaning for a product's base name.
STRIP_TOKENS = ["stk", "pk", "stykk", "engangs", "disposable", "flergangs", "reusable"]
#: Words that name a product type.
TYPE_KEYWORDS = [
    "hanske", "hansker", "glove", "gloves", "bandasje", "bandage", "dressing", "kompress", "compress", "swab", "sprøyte", "syringe", "kanyle", "needle", "nål",
    "kateter", "catheter", "sutur", "suture", "plaster", "tape", "frakk", "gown", "munnbind", "mask", "slange", "tube", "tubing", "sonde", "probe", "skalpell", "scalpel", "blade",
]
#: What varies in a family: the pattern of each dimension in a lower-cased text (group 1 is its value).
DIMENSION_PATTERNS = {
    "size": r"\b(x{0,3}s|x{0,3}l|m)\b", "number": r"\b(?:str\.?|størrelse|size)\s*(\d+(?:[.,]\d+)?)\b", "gauge": r"\b(\d{1,2})\s*g\b",
    "dimension": r"\b(\d+(?:[.,]\d+)?\s*x\s*\d+(?:[.,]\d+)?(?:\s*x\s*\d+(?:[.,]\d+)?)?)\s*(cm|mm|m)?\b", "volume": r"\b(\d+(?:[.,]\d+)?)\s*(ml|l|µl)\b", "ch": r"\b(?:ch|fr\.?)\s*(\d+)\b",
    "suture": r"\b(?:usp\s*)?(\d+[-/]0)\b", "side": r"\b(venstre|høyre|left|right|sin|dex)\b", "length": r"\b(\d+(?:[.,]\d+)?)\s*(mm|cm|m)\b",
}
#: Keys of details that give a dimension.
DIMENSION_KEYS = {"size": "størrelse|size", "gauge": "gauge", "length": "lengde|length", "width": "bredde|width", "colour": "farge|color|colour", "volume": "volum|volume", "ch": r"ch\b|french", "diameter": "diameter"}
#: Names of dimensions, in whose order a family lists them.
DIMENSION_NAMES = {
    "width": "Bredde", "ch": "CH", "diameter": "Diameter", "dimension": "Dimensjon", "colour": "Farge", "gauge": "Gauge", "length": "Lengde", "side": "Sidevalg", "size": "Størrelse", "suture": "Trådstørrelse", "volume": "Volum",
}
#: Hundredths of a score times 0.85, where the product ends in a half: what rounding its binary value gives.
REDUCED_HALVES = {10: 9, 30: 26, 50: 42, 70: 59, 90: 77}
#: Values that stand for a missing one.
PLACEHOLDERS = ["ukjent", "unknown", "n/a", "-", ".", "na", "ingen", "test", "todo", "tbd", "xxx", "placeholder"]
NO_MANUFACTURER = ["ukjent", "unknown", "n/a", "-", ".", "na", "ingen"]
NO_CATEGORY = ["ukjent", "annet", "diverse", "other", "uncategorized"]
#: Words that say nothing of a product, and of a category.
COMMON_WORDS = ["og", "i", "for", "med", "til", "av", "en", "et", "den", "det", "de", "er"]
COMMON_WORDS_OF_CATEGORIES = ["og", "i", "for", "med"]
#: Names that name nothing, and English words of which two call for a translation; matched as substrings.
GENERIC_NAMES = ["produkt", "vare", "artikkel", "item", "product", "test"]
ENGLISH_NAMES = ["gloves", "bandage", "tape", "pack", "box", "piece"]
SENTINELS = ["none", "nan", "null", "na", "n/a", "", "<na>"]
#: Words of a real specification, for areas and, with five more, for fields; matched as substrings.
SPEC_KEYWORDS = [
    "mm", "cm", "m", "ml", "l", "g", "kg", "stk", "pk", "µm", "størrelse", "size", "materiale", "material", "farge", "color", "vekt", "weight", "lengde", "length",
    "bredde", "width", "høyde", "height", "tykkelse", "thickness", "diameter", "latex", "nitril", "vinyl", "polyester", "bomull", "cotton",
    "steril", "sterile", "usteril", "non-sterile", "engangs", "disposable", "flergangs", "reusable",
]
FIELD_KEYWORDS = [*SPEC_KEYWORDS, "ce-merket", "ce-marked", "iso", "en-", "astm"]
#: Keys that details of a specification usually have: for fields, and for areas.
EXPECTED_DETAILS = ["størrelse", "size", "materiale", "material", "farge", "color", "vekt", "weight", "lengde", "length", "bredde", "width"]
KEY_DETAILS = ["størrelse", "size", "materiale", "material", "farge", "color", "vekt", "weight"]
#: Parts of keys that name packaging: for fields, and for areas.
PACKAGING_KEYS = [
    "antall i pakn", "antall per pakn", "antall pr pakn", "antall i forpakn", "antall pr forpakn", "pakningsstørrelse", "pack size", "enheter i pakn", "enheter per pakn", "enheter pr pakn",
    "stk i pakn", "stk per pakn", "stk pr pakn", "antall i inner", "transport", "kolli", "pall", "antall i trans", "antall pr trans",
]
PACKAGING_AREA_KEYS = [
    "antall i pakn", "antall per pakn", "antall pr pakn", "antall i forpakn", "antall pr forpakn", "pakningsstørrelse", "pack size", "enheter i pakn", "enheter per pakn", "enheter pr pakn", "transport", "kolli", "pall",
]
#: Parts of an address that are no category.
URL_PARTS = ["nb-no", "products", "https:", "http:", "www.onemed.no"]
#: Weights of fields in a product's total, in halves, and hundredths that each status counts.
FIELD_WEIGHTS = {"name": 4, "description": 3, "specification": 4, "manufacturer": 4, "mfr_number": 3, "category": 2, "packaging": 2, "image": 3, "brand": 1, "consistency": 1}
STATUS_POINTS = {"STRONG": 100, "OK": 100, "WEAK": 65, "SHOULD_IMPROVE": 50, "MANUAL_REVIEW": 40, "REQUIRES_MANUFACTURER": 25, "MISSING": 0, "PROBABLE_ERROR": 0}
#: Weights of areas, in quarters, their labels, and their names in explanations.
AREA_WEIGHTS = {"name": 8, "description": 8, "specification": 8, "images": 6, "attributes": 4, "documents": 4, "manufacturer": 6, "category": 3, "packaging": 3}
AREA_LABELS = {
    "name": "Produktnavn", "description": "Beskrivelse", "specification": "Spesifikasjon", "images": "Bilder", "attributes": "Attributter", "documents": "Dokumentasjon",
    "manufacturer": "Produsent", "category": "Kategori", "packaging": "Pakningsinformasjon",
}
#: Weights of image metrics, in hundredths.
IMAGE_WEIGHTS = {"resolution": 15, "blur": 20, "brightness": 10, "contrast": 10, "background": 15, "edge": 10, "fill": 20}
#: How far a source of image candidates is trusted, and what a candidate without any identity gets.
SOURCE_TRUST = {1: 1.0, 2: 0.85, 3: 0.7, 4: 0.6, 5: 0.5}
SOURCE_BASELINE = {1: 0.15, 2: 0.12, 3: 0.08, 4: 0.06, 5: 0.05}
ENGLISH = ["the", "and", "for", "with", "this", "that", "are", "from", "of", "is", "to", "in"]
#: Endings of company names.
SUFFIXES = [" as", " ab", " gmbh", " inc", " ltd", " ag", " sa"]
#: Image addresses: endings, marks of image servers, and what no product image holds.
IMAGE_ENDINGS = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".tiff", ".bmp"]
IMAGE_MARKS = ["/image/", "/img/", "/photo/", "/media/", "/preview/", "/product-image/", "/produktbild/", "imagehandler", "/picture/", "/asset/"]
IMAGE_SKIPS = [
    "icon", "logo", "favicon", "placeholder", "1x1", "pixel", "spacer", "blank", "arrow", "flag", "banner", "cart", "checkout", "avatar", "social", "facebook", "twitter", "instagram", "linkedin", "youtube",
    "spinner", "loading", "thumb_small", "thumbnail_tiny",
]
LIKELY_ENDINGS = [".jpg", ".jpeg", ".png", ".webp"]
LIKELY_SKIPS = ["icon", "logo", "favicon", "placeholder", "1x1", "pixel", "spacer", "blank"]
#: Labels of verification, in order of trust.
VERIFICATION_LABELS = {
    "EXACT_MATCH": "Verifisert mot produktside", "NORMALIZED_MATCH": "Verifisert (etter normalisering)", "SKU_IN_PAGE": "Delvis verifisert (artikkelnr funnet i sidetekst)",
    "CDN_ONLY": "Kun bilde bekreftet — produktside ikke funnet/hentet", "UNVERIFIED": "Ikke verifisert — krever manuell sjekk", "MISMATCH": "Mulig feil produkt — artikkelnr stemmer ikke",
    "AMBIGUOUS": "Usikker identitet — motstridende signaler",
}
#: What a product's name and details tell of its category, in order.
CATEGORY_PATTERNS = {
    r"\bhansk": "Hansker og beskyttelsesprodukter", r"\bbandasj": "Bandasjer og sårpleie", r"\bkompress": "Kompresser og sårpleie", r"\bplaster\b": "Plaster og sårforband", r"\bsprøyte": "Sprøyter og kanyler",
    r"\bkanyl": "Sprøyter og kanyler", r"\bkateter": "Kateter og urologi", r"\bsutur": "Suturer og sårlukning", r"\bmunnbind": "Åndedrettsvern og munnbind", r"\bfrakk": "Beskyttelsesklær", r"\bsterili": "Steriliseringsprodukter",
}
#: What an address tells of its manufacturer, in order.
MANUFACTURER_DOMAINS = {
    "molnlycke": "Mölnlycke Health Care", "coloplast": "Coloplast", "bbraun": "B. Braun", "b-braun": "B. Braun", "smith-nephew": "Smith & Nephew", "smithnephew": "Smith & Nephew", "medline": "Medline",
    "hartmann": "Paul Hartmann", "essity": "Essity", "sca": "Essity (SCA)", "abena": "Abena", "dansac": "Dansac (Coloplast)", "convatec": "ConvaTec", "cardinal": "Cardinal Health", "ansell": "Ansell",
    "sempermed": "Sempermed", "medasense": "Medasense", "3m": "3M",
}
#: How much better a candidate is than what a product's image is now, in hundredths, and what its source adds.
IMPROVEMENT = {"missing": 95, "low_quality": 70, "poor_background": 50, "review": 30}
IMPROVEMENT_BOOST = {"manufacturer_mediabank": 10, "manufacturer_website": 5}
#: Words that don't count as shared by a description and a page.
OVERLAP_STOPS = ["og", "i", "med", "for", "av", "en", "et", "den", "det", "er", "på", "til", "fra", "som", "the", "and", "or", "with", "in", "of", "a", "an", "mm", "stk", "pk"]
#: Lines that aren't description text, each by the pattern that begins or holds it.
JUNK_HEADER = (
    r"^(?:størrelseskode|størrelses?\s*kode|size\s*code|dispenser\s*/?\s*kartong|dispenser\s*/?\s*carton|lengde\s*dispenser|bredde\s*dispenser|bestillingsnummer|order\s*(?:number|code|no)"
    r"|art\.?\s*(?:nr|nummer|no)|varenummer|item\s*no|ref\.?\s*(?:nr|no|nummer|kode)|farge\s*kode\b|colour\s*code|color\s*code|antall\s*(?:pr|per|i)\s*(?:eske|kartong|pall|kolli)|enhet|unit|qty|mengde|innhold\b|contents\b)"
)
JUNK_METADATA = (
    r"^(?:produktdatablad|product\s*data\s*sheet|technical\s*data\s*sheet|side\s+\d+|page\s+\d+|dato\s*:|date\s*:|versjon|version|rev\b|www\.\S+|copyright|©|\(c\)|all\s*rights?\s*reserved|printed\s+in|onemed\s*(?:ab|as|oy|norge))\b"
)
JUNK_PATTERNS = {
    "header": JUNK_HEADER, "metadata": JUNK_METADATA, "date": r"^\d{2,4}[.\-/]\d{2}[.\-/]\d{2,4}$", "quantity": r"^\d+\s*/\s*\d+$", "article": r"^(?:N?\d{5,}[\-\s]?\d*|[A-Z]{1,3}\d{5,})", "row": r"^(?:\d[\d.,]*\s+){2,}",
    "section": r"\b(?:salgsenhet|transportkartong|produktdatablad)\b", "maker": r"^(?:produsent|manufacturer|leverandør|supplier)\s*:", "count": r"^antall\s*(?:pr|per|i|/)\s*", "variant": r"\b\d{4,7}\s+\S+.*?\d+\s*/\s*\d+",
    "copyright": r"^(?:©|copyright|\(c\))",
}
#: What no description may hold, in order of the check.
REJECTED = {
    "number": r"\b\d{5,}\b", "quantity": r"\b\d+\s*/\s*\d+\b", "page": r"\bside\s+\d+\b", "date": r"\b\d{4}[-/.]\d{2}[-/.]\d{2}\b", "table": r"størrelseskode|dispenser\s*/\s*kartong|bestillingsnummer", "sheet": "produktdatablad",
    "unit": r"\bsalgsenhet\b", "carton": r"\btransportkartong\b",
}
#: Those of both in which case doesn't count.
ANY_CASE = ["header", "metadata", "section", "maker", "count", "copyright", "page", "table", "sheet", "unit", "carton"]
#: Rows of a table of variants within a text, and a heading that may stand before them.
VARIANT_ENTRY = r"\b\d{4,7}\s+[A-ZÆØÅa-zæøå®].{5,}?\d+\s*/\s*\d+"
VARIANT_HEADING = r"\s*(?:beskrivelse|størrelse|total|antall|ref)\s*$"

# What product pages are read by: ids of sections in their order, class patterns, keys of packaging, patterns over page text.
PAGE_DESCRIPTIONS = ("accordionItem_descriptionAndDocuments", "accordionItem_description", "accordion-description")
PAGE_SPECIFICATIONS = ("accordionItem_specifications", "accordionItem_specification", "accordionItem_spesifikasjon", "accordion-specifications", "accordion-specification")
PAGE_PAIRS = r"spec|detail|attribute|property|feature|technical|egenskap"
PAGE_UNIT = (
    "antall i pakn", "antall per pakn", "antall pr pakn", "antall i forpakn", "antall pr forpakn", "pakningsstørrelse", "pack size", "enheter i pakn", "enheter per pakn", "enheter pr pakn",
    "stk i pakn", "stk per pakn", "stk pr pakn", "antall i inner",
)
PAGE_TRANSPORT = ("transport", "kolli", "ytterforpakn", "antall i trans", "antall pr trans")
PAGE_PACKAGING = (
    r"(\d+)\s*(?:stk|st)\s*(?:per|pr|/)\s*(?:forpakning|pakning|frp|pk)",
    r"(?:forpakning|pakning|frp|pk)[\s:]+(\d+)\s*(?:stk|st)?",
    r"Antall\s*(?:per|pr|i)\s*(?:forpakning|pakning)[\s:]*(\d+)",
    r"Antall\s+i\s+pakn\w*[\s:]+(\d+)\s*(?:stk|st)?",
)
PAGE_SHIPPING = r"(?:transport(?:forpakning|pakning|pakke|-pakke))[\s:]*(\d+)"
PAGE_MAKER_NUMBER = (
    r"(?:Produsentens?\s*(?:art\.?|varenr|artikkel)(?:nummer|nr)?|Lev\.?\s*art\.?\s*nr)[\s.:]*([A-Za-z0-9\-/]+)",
    r"(?:Manufacturer|MFR|Supplier)\s*(?:art|item|part)\s*(?:no|nr|number)?[\s.:]*([A-Za-z0-9\-/]+)",
)

# Enrichment: names of sources, confidence (hundredths) from which no review is needed, what values must and mustn't hold.
SOURCE_NAMES = {"page": "OneMed produktside", "pdf": "Produktdatablad (PDF)", "manufacturer": "Produsent", "structuring": "Strukturering av kildedata"}
AUTO_CONFIDENCE = 75
SENTENCE_WORDS = r"\b(?:og|for|som|med|til|av|er|i|and|for|with|the|is)\b"
PACKAGING_SIGNS = (
    r"(?i)\d+\s*(?:stk|pk|stykk|per|pr|i\s+pakning)", r"(?i)(?:eske|kartong|pall|pose|boks|pakke|forpakning)\b", r"(?i)\d+\s*(?:x\s*\d+)", r"(?i)(?:inner|outer|master|transport)\s*(?:pak|box|cart)",
)
NOT_PACKAGING = (
    r"(?i)(?:oppbevar|lagr)\w*\s+(?:tørt|kjølig|mørkt)", r"(?i)(?:brukes?\s+til|designed\s+for|intended\s+for|suitable\s+for)", r"(?i)(?:fordeler|benefits|advantages|features)\b", r"(?i)(?:instruksjon|instruction|bruksanvisning)\b",
)
BUILT_FROM = {"Materiale": ("Materiale", "Material"), "": ("Lengde", "Størrelse", "Size"), "Pakning": ("Antall i pakningen", "Antall per pakning", "Pack size")}
BRAND_KEYS = ("Merkevare", "Brand", "Merke")

# Labelled values in the texts of data sheets: patterns by field in their order, longest values, what lowers their worth.
SHEET_PATTERNS = {
    "product_name": (r"(?:produktnavn|product\s*name|varenavn|betegnelse)\s*[:\-]?\s*(.+?)(?:\n|$)",),
    "description": (
        r"(?:beskrivelse|description|produktbeskrivelse|product\s*description)\s*[:\-]?\s*((?:(?!\n\n).)+)",
        r"(?:beskrivelse|description|produktbeskrivelse|product\s*description)\s*[:\-]?\s*(.+?)(?:\n|$)",
    ),
    "manufacturer": (r"(?:produsent|manufacturer|leverand.r|supplier|fabrikant)\s*[:\-]?\s*(.+?)(?:\n|$)",),
    "manufacturer_article_number": (
        r"(?:produsentens?\s*(?:vare|artikkel)?\s*(?:nummer|nr|kode)|manufacturer\s*(?:article|item|ref)?\s*(?:number|no|code|nr))\s*[:\-]?\s*(.+?)(?:\n|$)",
        r"(?:ref[\.\s]*(?:nr|no|number|kode))\s*[:\-]?\s*(.+?)(?:\n|$)",
    ),
    "packaging_info": (
        r"(?:pakning|emballasje|packaging|pack\s*size|pakningsstørrelse|forpakning)\s*[:\-]?\s*(.+?)(?:\n|$)",
        r"(?:antall\s*(?:i|per|pr)?\s*(?:pakning|eske|kartong|pall))\s*[:\-]?\s*(.+?)(?:\n|$)",
    ),
    "materials": (r"(?:materiale?|material|sammensetning|composition)\s*[:\-]?\s*(.+?)(?:\n|$)",),
    "dimensions": (r"(?:dimensjoner?|dimensions?|st.rrelse|size|m.l)\s*[:\-]?\s*(.+?)(?:\n|$)",),
}
#: What a lower-cased text must hold for a pattern to match, so that texts without it are not searched; a dot is any character. Letters that a pattern takes for an ASCII one where case doesn't count, as they stand in lower case.
SHEET_LABELS = {
    "product_name": (("produktnavn", "product", "varenavn", "betegnelse"),), "description": (("beskrivelse", "description"), ("beskrivelse", "description")), "manufacturer": (("produsent", "manufacturer", "leverand", "supplier", "fabrikant"),),
    "manufacturer_article_number": (("produsent", "manufacturer"), ("ref",)), "packaging_info": (("pakning", "emballasje", "pack"), ("antall",)), "materials": (("material", "sammensetning", "composition"),), "dimensions": (("dimensjon", "dimension", "rrelse", "size", "m.l"),),
}
SHEET_LETTERS = ("i\u0307", "\u0131", "\u017f")
SHEET_LONGEST = {"product_name": 200, "description": 2000, "manufacturer": 100, "manufacturer_article_number": 60, "packaging_info": 200, "materials": 300, "dimensions": 200}
SHEET_BOILERPLATE = (
    r"(?i)(?:oppbevar|lagr)\w*\s+(?:tørt|kjølig|mørkt|romtemperatur)", r"(?i)(?:best\s*før|holdbar|expir|shelf\s*life)", r"(?i)(?:les\s+bruksanvisning|read\s+instructions)", r"(?i)(?:kontakt\s+(?:lege|helsepersonell)|consult\s+(?:doctor|physician))",
    r"(?i)(?:www\.\S+\.(?:com|no|se|dk))", r"(?i)(?:copyright|©|\ball\s+rights\s+reserved)",
)
SHEET_PACKAGING = (r"(?i)\d+\s*(?:stk|pk|stykk|per|i\s+(?:pakning|eske|kartong|pall))", r"(?i)(?:eske|kartong|pall|pose|boks|pakke|forpakning|inner|outer|master)\b", r"(?i)\d+\s*(?:x\s*\d+)")
SHEET_LINE = r"^([A-Z\u00C0-\u00FF][a-z\u00C0-\u00FF\s]+?)\s*[:\t]\s*(.+?)$"
SHEET_SKIPPED = ("side", "page", "dato", "date", "rev")

# Workbooks: headers of article numbers as they are compared, and the ERP's headers with its fields.
ARTICLE_HEADERS = ["artikkelnummer", "artikkel", "artikkelnr", "artnr", "artnummer", "varenummer", "varenr", "article", "articlenumber", "sku", "item", "itemnumber", "produktnummer"]
ERP_COLUMNS = {
    "Item. No": "article_number", "GID": "gid", "Item description": "item_description", "Specification": "specification", "Supplier": "supplier", "Supplier Item.no": "supplier_item_no", "Product Brand": "product_brand", "Web Title": "web_title",
    "Web Text": "web_text",
}
ERP_IDENTIFIERS = ("article_number", "gid", "supplier_item_no")

# Reports: what a verification says where it has no evidence of its own, labels of fields and priorities.
VERIFICATION_EVIDENCE = {
    "EXACT_MATCH": "Produktidentitet bekreftet: artikkelnummeret stemmer eksakt med produktsiden.", "NORMALIZED_MATCH": "Produktidentitet bekreftet etter normalisering av artikkelnummer.",
    "SKU_IN_PAGE": "Artikkelnummeret ble funnet i sideteksten, men ikke i produktets strukturerte data. Svakere bevis.",
    "CDN_ONLY": "Produktbilde ble funnet i bildekatalogen, men ingen produktside med detaljer ble funnet eller hentet. Produktidentiteten er usikker.", "UNVERIFIED": "Produktet kunne ikke verifiseres mot nettstedet. Vurder manuelt om dataene er korrekte.",
    "MISMATCH": "Artikkelnummeret på produktsiden stemmer IKKE med forventet artikkel. Dataene kan tilhøre feil produkt.", "AMBIGUOUS": "Motstridende signaler gjør det uklart om dette er riktig produkt. Krever manuell vurdering.",
}
FIELD_LABELS = {
    "name": "Produktnavn", "description": "Beskrivelse", "specification": "Spesifikasjon", "manufacturer": "Produsent", "mfr_number": "Produsentens varenummer", "brand": "Merkevare", "category": "Kategori", "packaging": "Pakningsinformasjon", "image": "Bildekvalitet",
}
PRIORITY_LABELS = {"high": "Høy", "medium": "Medium", "low": "Lav"}
