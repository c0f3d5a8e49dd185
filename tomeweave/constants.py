"""Fixed values. They have to equal the documented ones for results to agree."""

# Python's str.strip() whitespace; Spark's trim() alone removes only spaces.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

UNKNOWN = "N/A"

# Chapter-title candidates that are not titles. Matched without
# regard to case, from the start of the stripped text.
NOT_A_TITLE = [
    r"image\s*$",
    r"\d+\.(tiff|jpg|jpeg|png|gif|bmp)\s*$",
    r"e\d+_i\d+\.(jpg|jpeg|png|gif|tiff|bmp)\s*$",
    r"[a-z0-9_]+\.(jpg|jpeg|png|gif|tiff|bmp)\s*$",
    r"figure\s*\d*\s*$",
    r"illustration\s*$",
    r"map\s*$",
    r"contents\s*$",
    r"table\s+of\s+contents\s*$",
    r"appendix\s*$",
    r"acknowledgments?\s*$",
    r"dedication\s*$",
    r"about\s+the\s+author\s*$",
    r"copyright\s*$",
    r"cover\s*$",
    r"title\s*page\s*$",
    r"tor\s+books\s+by\s+",
    r"books\s+by\s+",
    r"also\s+by\s+",
    r"other\s+books\s+by\s+",
    r"a\s+preview\s+of\s+",
    r"preview\s*$",
    r"excerpt\s+from\s+",
    r"bonus\s+content\s*$",
    r"glossary\s*$",
    r"index\s*$",
    r"dramatis\s+personae\s*$",
    r"n/a\s*$",
]

# Names that head a point-of-view chapter.
POV_NAMES = [
    "PROLOGUE", "EPILOGUE", "ARYA", "BRAN", "CATELYN", "CERSEI", "DAENERYS", "DAVOS",
    "EDDARD", "JAIME", "JON", "SANSA", "THEON", "TYRION", "SAMWELL", "BRIENNE", "AERON",
    "AREO", "ARIANNE", "ASHA", "BARRISTAN", "CONNINGTON", "MELISANDRE", "QUENTYN",
    "VICTARION", "NED", "DANY", "SAM",
]

# Chapter header patterns, most specific first.
NUMBERED_HEADERS = [
    r"CHAPTER\s*(\d+)\s*\n+Image\s*\n+([^\n]+)",
    r"(PROLOGUE|EPILOGUE)\s*\n+Image\s*\n+([^\n]+)",
    r"CHAPTER\s*(\d+)\s*\n+([^\n]+)",
    r"CHAPTER\s*\n+(\d+)\s*\n+([^\n]+)",
    r"CHAPTER\s*(\d+)\s*\n+\s*\n+([^\n]+)",
    r"CHAPTER\s*([A-Za-z0-9]+):\s*([^\n]+)",
    r"CHAPTER:\s*([^\n]+)",
    r"(?:PROLOGUE|EPILOGUE)\s*\n+([^\n]+)",
    r"CHAPTER\s*(\d+)\s*$",
    r"(?:PROLOGUE|EPILOGUE)\s*$",
]
WORDED_HEADERS = [
    r"CHAPTER\s+([A-Za-z0-9]+)\s*\n+([^\n]+)",
    r"CHAPTER\s+([A-Za-z0-9]+)\s*$",
]
POV_HEADERS = [
    r"^\s*(PROLOGUE|EPILOGUE)\s*\n",
    r"^\s*(" + "|".join(POV_NAMES) + r")\s*\n",
]
PLAIN_HEADER = r"CHAPTER\s*(\d+)"

# Separators of the recursive splitter, tried in order.
LITERAL_SEPARATORS = ["\n\n", ". ", "! ", "? ", '"\n', '" ', "\n", " ", ""]
SCENE_BREAK = "\n*   *   *\n"
SECTION_SEPARATORS = {
    "wheel of time": [
        r"\nEPILOGUE\s*\n", r"\nepilogue\s*\n", r"\nEpilogue\s*\n",
        r"\nPROLOGUE\s*\n", r"\nprologue\s*\n", r"\nPrologue\s*\n",
        r"\nCHAPTER\s*\d*\s*\n", r"\nchapter\s*\d*\s*\n", r"\nChapter\s*\d*\s*\n",
    ],
    "harry potter": [
        r"\nCHAPTER\s+[A-Za-z0-9]+\s*\n", r"\nChapter\s+\d+\s*\n",
        r"\nC\s*H\s*A\s*P\s*T\s*E\s*R\s+[A-Za-z0-9]+\s*\n",
    ],
    "song of ice and fire": [
        r"\nPROLOGUE\s*\n", r"\nEPILOGUE\s*\n",
        r"\n(?:" + "|".join(POV_NAMES) + r")\s*\n",
    ],
}
CHUNK_SIZE = 4_000
CHUNK_OVERLAP = 800

# Series names and their folders; the ontology a series uses and its section prefix.
SERIES_FOLDERS = {
    "harry_potter": "harry_potter",
    "wheel_of_time": "wheel_of_time",
    "song_of_ice_and_fire": "song_of_ice_and_fire",
    "asoiaf": "song_of_ice_and_fire",
}
SERIES_ONTOLOGY = {
    "Harry Potter": ("Harry Potter", "harry_potter"),
    "A Song of Ice and Fire": ("A Song of Ice and Fire", "asoiaf"),
    "asoiaf": ("A Song of Ice and Fire", "asoiaf"),
    "The Wheel of Time": ("The Wheel of Time", "wheel_of_time"),
    "wheel_of_time": ("The Wheel of Time", "wheel_of_time"),
}

# Question categories (id, display name) and complexity levels.
CATEGORIES = [
    ("characters", "Characters & Identities"),
    ("events", "Major Events & Deaths"),
    ("magic", "Magic, Weaves & Power Mechanics"),
    ("artifacts", "Artifacts, Places & Mystical Objects"),
    ("lore", "Lore & World-Building"),
]
COMPLEXITIES = ["simple", "moderate", "complex", "expert"]
PROPOSAL_TYPES = ["new_entity_type", "new_relationship_type", "new_renaming_rule"]

# Embedding calls.
EMBED_RETRIES = 5
EMBED_BACKOFF_SECONDS = 2.0
RATE_LIMIT_FLOOR_SECONDS = 60.0
RATE_LIMIT_MARKS = ["429", "resource exhausted", "quota exceeded"]
TRANSIENT_MARKS = ["503", "unavailable", "timeout", "deadline"]

# Retrieval.
TOP_K = 20
BM25_K1 = 1.5
BM25_B = 0.75
DENSE_WEIGHT = 0.7
SPARSE_WEIGHT = 0.3
RRF_K = 60

# Request quotas and batching.
REQUESTS_PER_MINUTE = 1_000
REQUESTS_PER_DAY = 10_000
TOKENS_PER_MINUTE = 1_000_000
QA_BATCH, QA_OVERLAP, EVAL_BATCH = 10, 2, 100
ABORT_AFTER = 3

# How chunk texts are labelled and what an audit says without a text.
CATEGORY_BLOCK = "\n\n[Chunk ID: {id}]\n{text}"
EVALUATION_BLOCK = "=== CHUNK_ID: {id} ===\n[Book: {book} | Chapter: {chapter}]\n{text}\n=== END {id} ===\n"
AUDIT_BLOCK = "[Chunk ID: {id}]\n{text}"
NO_SOURCES = "No source chunk IDs provided in metadata."
MISSING_SOURCES = "WARNING: Chunks with IDs [{ids}] not found in rag_chunks collection."
UNNAMED = "Unknown"
