"""Fixed values of the audit: constants, word lists and patterns that its results depend on."""

# Constants.
STUDY_WINDOW = (2016, 2024)
PLAUSIBLE_YEARS = (1900, 2035)
HEADER_CHARS = 1800
DATE_WINDOW = 400
OCR_PAGE_CHARS = 100
SPARSE_CHARS = 300
TEXT_CHARS = 120
NUMBER_LOOK_BACK = 100
LOOK_BACK = 120
WEIGHTS = {"enactment": 0.45, "number": 0.25, "series": 0.20, "approval": 0.10}
MISFILE_BAR = 0.45
RELOCATE_BAR = 0.60
COUNCIL_ANCHOR = (18, 2016, 3)
STATUSES = ("valid", "misfiled", "out_of_scope", "review", "unresolved")
METHODS = ("Digital", "Hybrid", "OCR")
CATEGORIES = ("duplicate", "out_of_scope", "misfiled", "review", "unresolved", "sparse")
REASONS = {"duplicate": "duplicate", "out_of_scope": "out_of_scope", "misfiled": "misfiled", "review": "low_confidence_review", "unresolved": "unresolved", "sparse": "sparse_or_unreadable"}
DEFAULT_CATEGORIES = ("out_of_scope", "duplicate", "sparse")

# Month names.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4,
    "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9,
    "sept": 9, "sep": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
MONTH = "(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"

# Patterns, in Java's dialect; case-insensitive, Unicode classes, only \n ends a line.
FLAGS = "(?iUd)"
FILENAME_NUMBER = r"(?:ordinance|ord)\.?\s*(?:no\.?|number|#)?\s*(\d{1,5})\s*[-–—_\s]\s*(\d{2,4})\b"
HEADER_NUMBER = r"ORDINANCE\s+(?:NO\.?|NUMBER|#)\s*(\d{1,5})\s*[-–—_]\s*(\d{2,4})\b"
CITATION_CUE = (
    r"(amend(?:ing|ed|atory)?|repeal(?:ing|ed)?|supersed(?:ing|ed)?|revok(?:ing|ed)?"
    r"|pursuant\s+to|under|violation\s+of|otherwise\s+known\s+as|known\s+as|as\s+amended"
    r"|provided\s+(?:for\s+)?(?:in|by|under)|in\s+relation\s+to|amendment\s+to|section\s+\d+\s+of)"
    r"[^;:\n]{0,90}$"
)
RECITED_ACT = r"\bwas\s+(?:approved|enacted|passed)\b[^.;:]{0,40}$"
INSTRUMENT = r"\bORDINANCE\s+(?:NO|NUMBER)|\bSERIES\s+OF\s+(?:19|20)\d{2}|\bR\.?\s?A\.?\s*\d+|\bREPUBLIC\s+ACT"
SERIES = r"SERIES\s*(?:OF|NO\.?)?\s*[,:]?\s*((?:19|20)\d{2})"
SESSION = r"\d{1,3}\s*(?:st|nd|rd|th)\s+(?:REGULAR|SPECIAL|INAUGURAL)\s+SESSION"
COUNCIL = r"(\d{1,2})\s*(?:st|nd|rd|th)\s+(?:CITY\s+)?COUNCIL"
ENACTED = r"\b(ENACTED|ENACTMENT|PASSED\s+AND\s+APPROVED|ADOPTED)\b|(?:regular|special|inaugural)\s+session[^.\n]{0,60}held"
APPROVED = r"\bAPPROVED\b"
SIGNATURE = r"\bAPPROVED\b|\bCITY\s+MAYOR\b|\bACTING\s+MAYOR\b"
MONTH_FIRST = r"\b" + MONTH + r"\.?\s+(\d{1,2})\s*(?:st|nd|rd|th)?\s*,?\s*((?:19|20)\d{2})\b"
DAY_FIRST = r"\b(\d{1,2})\s*(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?" + MONTH + r"\.?\s*,?\s*((?:19|20)\d{2})\b"
NUMERIC_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]((?:19|20)\d{2})\b"
BARE_YEAR = r"\b((?:19|20)\d{2})\b"
TITLE = r"(AN?\s+ORDINANCE\b[\s\S]{0,900}?)(?=\n\s*\n|\bBE\s+IT\s+ORDAINED\b|\bWHEREAS\b|\bSECTION\s+1\b)"
SECTION = r"(?m)^\s*SEC(?:TION|\.)?\s*\d+"
WHEREAS = r"\bWHEREAS\b"
SPONSOR = r"(?:SPONSOR|AUTHOR|PROPONENT)S?\s*[:\-]\s*([^\n]{3,120})"
# A name above a signatory's office. Possessive within a word and from a word's beginning: it finds what the plain pattern
# "([A-Z][A-Za-z.\-]+(?:\s+[A-Z][A-Za-z.\-]+){1,4})\s*\n\s*" finds, but doesn't try each place again.
NAME_ABOVE = r"(?<![a-z])([a-z][a-z.\-]++(?:\s++[a-z][a-z.\-]++){1,4})\s*\n\s*"
MAYOR_OFFICE = r"(?:CITY\s+MAYOR|ACTING\s+MAYOR)"
PRESIDING_OFFICE = r"(?:CITY\s+VICE[\s\-]?MAYOR|PRESIDING\s+OFFICER)"
MAYOR = NAME_ABOVE + MAYOR_OFFICE
PRESIDING = NAME_ABOVE + PRESIDING_OFFICE
AMENDATORY = r"\bamend(?:ing|ed|atory)\b"
TITLE_NOISE = r"(?:,?\s*(?:SERIES\s+OF\s+(?:19|20)\d{2}|AS\s+AMENDED|AND\s+FOR\s+OTHER\s+PURPOSES))"
PAGE_FURNITURE = r"^\s*(?:-\s*\d+\s*-|\[?\d{1,3}\]?|page\s+\d+(?:\s+of\s+\d+)?|p\.\s*\d+|\d+\s*\|\s*page)\s*$"
NOISE_LINE = r"^[^A-Za-z0-9]{0,4}[^A-Za-z0-9\s]{2,}[^A-Za-z0-9]{0,4}$"
HYPHEN_BREAK = r"(\w)[-‐‑]\s*\n\s*(\w)"

# Repairs of misread words.
OCR_REPAIRS = (
    (r"\bORDlNANCE\b", "ORDINANCE"),
    (r"\bSANGGUN[1I]ANG\b", "SANGGUNIANG"),
    (r"\bPANLUNGS0D\b", "PANLUNGSOD"),
    (r"\bSER[1I]ES\b", "SERIES"),
    (r"\bENACTEO\b", "ENACTED"),
    (r"\bAPPR0VED\b", "APPROVED"),
    (r"\bSECT[1I]ON\b", "SECTION"),
)

# Masthead lines.
MASTHEADS = (
    "republic of the philippines", "city of davao", "davao city",
    "office of the sangguniang panlungsod", "sangguniang panlungsod",
    "office of the city council", "lungsod ng dabaw",
)

# Words that are no keywords.
STOP_WORDS = (
    "an", "a", "the", "of", "to", "for", "and", "or", "in", "on", "at", "by",
    "with", "from", "this", "that", "these", "those", "be", "it", "is", "are",
    "was", "were", "shall", "may", "other", "purposes", "ordinance", "city",
    "davao", "hereby", "thereof", "therein", "such", "any", "all", "as", "its",
    "into", "under", "upon", "which", "who", "whom", "not", "no", "amending",
    "amended", "providing", "provided", "establishing", "known", "otherwise",
    "appropriating", "funds", "therefor", "certain", "same", "per", "also",
    "series", "thereto", "pursuant", "repealing", "further",
)

# What the records' notes say.
NOTE_ENACTED_APPROVED = "enacted %d vs approved %d"
NOTE_SERIES_NUMBER = "series %d vs ord-no %d"
NOTE_HEADER_NUMBER = "number read from header, filename unparsed"
NOTE_NO_TEXT = "no extractable text; filename-only inference"
NOTE_VERIFIED, NOTE_VERIFIED_BY, NOTE_EVIDENCE = "manually verified", " by ", "; evidence: "
REASON_NO_YEAR = "no year signal recovered"
REASON_BELOW_BAR = "mismatch below confidence bar"
NO_YEAR_PATH = "Manual review"

# The wording of a note in the vault.
NOTE_TAGS = ("ordinance", "davao")
NUMBERED = "Ordinance No. "
NO_CONFLICT = "No conflicting signals recorded."
CALLOUT = ("> [!", "] Temporal status: ", "\n> Filed under ", ", resolved to ", " at confidence ", ".\n> ")
SIGNAL_TABLE = "## Temporal signals\n\n| Signal | Year |\n| --- | --- |"
SIGNAL_ROWS = (
    ("Enactment date", "detected_enactment_year"), ("Ordinance number suffix", "detected_ordinance_no_year"),
    ("Series header", "detected_series_year"), ("Approval date", "detected_approval_year"),
)
CITES = "## Cites or amends\n\n"
CONTEXT = ("## Context\n\n- Year index: [[_Index ", "]]\n- Corpus overview: [[_Corpus MOC]]\n")
CLEANED = "## Cleaned text\n\n"
TRUNCATED = ("*Truncated to ", " of ", " characters. Full text: `", "`*\n\n")
INDEX_COUNTS = ("| Status | Count |", "| --- | --- |")
INDEX_DOCUMENTS = ("## Documents", "", "| Ordinance | Title | Status | Conf. | Enacted |", "| --- | --- | --- | --- | --- |")
INDEX_QUERY = ("## Live query", "", "```dataview", "TABLE ordinance_number, temporal_status, confidence_score, enactment_date", "SORT ordinance_number ASC", "```")
BACK_LINK = "Back to [[_Corpus MOC]]"
