"""Closed vocabularies of the civic-records domain."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Status domains, code maps, keyword lists and thresholds.
# The order inside each list matters, the first hit wins.
# ---------------------------------------------------------------------------

ATTENDANCE_STATUSES = ["present", "absent", "apology", "unknown"]
ATTENDANCE_CODES = {"P": "present", "A": "absent", "AP": "apology", "L": "present", "DE": "present", "LDE": "present"}
ATTENDANCE_KEYWORDS = [
    ("present", "present"), ("attended", "present"), ("absent", "absent"),
    ("apology", "apology"), ("apologies", "apology"), ("leave", "apology"),
]

BILL_STATUSES = ["introduced", "passed", "assented", "rejected", "withdrawn", "lapsed", "unknown"]
BILL_STATUS_KEYWORDS = [
    ("introduced", "introduced"), ("passed", "passed"), ("assented", "assented"), ("rejected", "rejected"),
    ("withdrawn", "withdrawn"), ("lapsed", "lapsed"), ("signed", "assented"), ("act", "assented"),
]
BILL_EVENT_KEYWORDS = [
    ("introduced", "introduced"), ("first reading", "first_reading"), ("second reading", "second_reading"),
    ("third reading", "third_reading"), ("committee", "committee_referral"), ("ncop", "ncop_concurrence"),
    ("passed", "passed"), ("assented", "assented"), ("signed", "assented"),
    ("withdrawn", "withdrawn"), ("lapsed", "lapsed"),
]
HOUSE_KEYWORDS = [("national assembly", "National Assembly"), ("ncop", "NCOP"), ("national council", "NCOP")]

VOTE_TYPE_KEYWORDS = [("bill", "bill_vote"), ("motion", "motion"), ("amendment", "amendment"), ("committee", "committee_decision")]
VOTE_RESULT_KEYWORDS = [
    ("agreed", "agreed_to"), ("negatived", "negatived"), ("adopted", "adopted"), ("tied", "tied"), ("withdrawn", "withdrawn"),
]
VOTE_VALUES = {
    "yes": "yes", "aye": "yes", "no": "no", "nay": "no", "abstain": "abstain", "absent": "absent", "present": "present",
}
DIVISION_MARKERS = [
    "division", "votes in favour", "votes against", "abstention", "voted in favour", "voted against",
    "put to a vote", "put to the vote",
]
VOTE_SIGNALS = [
    ("amendment agreed to", "amendment", "agreed_to"),
    ("amendment rejected", "amendment", "negatived"),
    ("amendment negatived", "amendment", "negatived"),
    ("bill was negatived", "bill_vote", "negatived"),
    ("bill was agreed to", "bill_vote", "agreed_to"),
    ("bill was adopted", "bill_vote", "adopted"),
    ("motion was agreed to", "motion", "agreed_to"),
    ("motion was negatived", "motion", "negatived"),
    ("negatived", "unknown", "negatived"),
    ("agreed to", "unknown", "agreed_to"),
    ("adopted", "unknown", "adopted"),
]
COUNT_PATTERNS = [
    (r"(\d+)\s+vot(?:es|ed)\s+in\s+favour", "yes"),
    (r"(\d+)\s+vot(?:es|ed)\s+against", "no"),
    (r"(\d+)\s+abstentions?", "abstain"),
]

ROLE_KEYWORDS = [
    ("chair", "Chairperson"), ("chairperson", "Chairperson"), ("co-chairperson", "Chairperson"), ("member", "Member"),
    ("alternate member", "Alternate"), ("alternate", "Alternate"), ("whip", "Whip"), ("minister", "Minister"),
    ("deputy minister", "Deputy Minister"),
]
PARTY_ALIASES = {
    "african national congress": ("African National Congress", "ANC"),
    "anc": ("African National Congress", "ANC"),
    "democratic alliance": ("Democratic Alliance", "DA"),
    "da": ("Democratic Alliance", "DA"),
    "economic freedom fighters": ("Economic Freedom Fighters", "EFF"),
    "eff": ("Economic Freedom Fighters", "EFF"),
    "umkhonto wesizwe": ("uMkhonto weSizwe", "MK"),
    "mk": ("uMkhonto weSizwe", "MK"),
    "inkatha freedom party": ("Inkatha Freedom Party", "IFP"),
    "ifp": ("Inkatha Freedom Party", "IFP"),
    "freedom front plus": ("Freedom Front Plus", "FF Plus"),
    "ff plus": ("Freedom Front Plus", "FF Plus"),
    "ff+": ("Freedom Front Plus", "FF Plus"),
    "actionsa": ("ActionSA", "ActionSA"),
    "good": ("GOOD", "GOOD"),
    "patriotic alliance": ("Patriotic Alliance", "PA"),
    "pa": ("Patriotic Alliance", "PA"),
    "african christian democratic party": ("African Christian Democratic Party", "ACDP"),
    "acdp": ("African Christian Democratic Party", "ACDP"),
    "united democratic movement": ("United Democratic Movement", "UDM"),
    "udm": ("United Democratic Movement", "UDM"),
    "african transformation movement": ("African Transformation Movement", "ATM"),
    "atm": ("African Transformation Movement", "ATM"),
    "rise mzansi": ("Rise Mzansi", "Rise Mzansi"),
    "build one south africa": ("Build One South Africa", "BOSA"),
    "bosa": ("Build One South Africa", "BOSA"),
    "al jama-ah": ("Al Jama-ah", "Al Jama-ah"),
    "al jamaah": ("Al Jama-ah", "Al Jama-ah"),
}
HONORIFICS = ["adv", "advocate", "dr", "hon", "honourable", "miss", "mr", "mrs", "ms", "prof", "professor"]
NON_PERSON_NAMES = [
    "apology", "apologies", "chairperson", "department", "minister", "national assembly", "none", "present", "unknown",
]
NON_PERSON_WORDS = ["committee", "department", "parliamentary", "secretary", "staff", "team"]
UNKNOWN_LABELS = ["unknown", "unk", "n/a", "none"]

CURRENT_SIGNALS = ["current positions:", "member of the national assembly", "member of parliament"]
FORMER_SIGNALS = ["former positions:", "former member", "resigned", "deceased", "not a current", "archived"]
CURRENT_URL_PART = "/position/member/parliament/"

QUESTION_LABELS = [
    "Question Number", "Question No", "Number", "No", "Asked By", "Question By", "Member", "MP", "Department",
    "Portfolio", "To Department", "Minister", "Answered By", "Reply By", "Asked Date", "Date Asked", "Question Date",
    "Asked On", "Answered Date", "Date Answered", "Reply Date", "Answered On", "Status", "Question", "Answer", "Reply",
]
QUESTION_DOC_TYPES = {
    "EXE_RQ_NA": ("Written question reply", "National Assembly", "answered_date"),
    "EXE_R_NCOP": ("Written question reply", "NCOP", "answered_date"),
    "HAN_R_NA": ("Question reply (Hansard)", "National Assembly", "answered_date"),
    "QUEST_PAP": ("Question paper", None, "asked_date"),
}
QUESTION_LINK_TOKENS = [
    "questions-and-replies", "question-papers", "question-replies", "question paper", "question reply",
    "parliamentary-question", "archive.parliament.gov.za/handle", "archive.parliament.gov.za/items", "exe_rq_na", "quest_pap",
]
QUESTION_PDF_TOKENS = ["question", "rq_", "exe_rq", "quest_pap", "rnw", "rno", "qne", "qce"]

SEARCH_STOP_WORDS = [
    "about", "and", "are", "did", "does", "from", "have", "into", "mp", "mps", "mentioning", "question", "questions",
    "asked", "ask", "show", "the", "their", "what", "is", "known", "tell", "me", "where", "which", "who", "with",
    "sits", "sit", "serve", "serves", "served", "hearing", "hearings", "enquiry", "inquiry", "testimony", "testified",
    "briefing", "committee", "committees", "on", "mr", "mrs", "ms", "dr", "adv", "prof", "hon", "anc", "da", "eff",
    "mk", "ifp",
]
DISPLAY_REPLACEMENTS = [
    ("â\u0080\u0099", "'"), ("Ã¢Â\u0080Â\u0099", "'"), ("â€™", "'"),
    ("’", "'"), ("‘", "'"),
    ("â\u0080¯", " "), ("\u202f", " "),
    ("â\u0080\u0091", "-"), ("‑", "-"), ("â\u0080\u0093", "-"), ("–", "-"),
    ("â\u0080\u0094", "-"), ("Ã¢Â\u0080Â\u0094", "-"), ("â€”", "-"), ("—", "-"),
    ("â\u0080¦", "..."), ("…", "..."),
    ("ã\u0080\u0090", "["), ("ã\u0080\u0091", "]"), ("【source】", ""), ("[source]", ""),
]

FORMAT_BY_EXTENSION = [
    (".csv", "csv"), (".json", "json"), (".pdf", "pdf"), (".xlsx", "xlsx"), (".xls", "xlsx"), (".html", "html"), (".htm", "html"),
]
FORMAT_BY_CONTENT = [
    ("csv", "csv"), ("json", "json"), ("pdf", "pdf"), ("spreadsheet", "xlsx"), ("excel", "xlsx"), ("html", "html"),
]
READINESS_BY_FORMAT = {
    "csv": "structured-candidate", "json": "structured-candidate", "xlsx": "structured-candidate",
    "html": "needs-parser-design", "pdf": "needs-parser-design", "unknown": "unknown",
}
STRUCTURED_FORMATS = ["csv", "xlsx", "json"]
VOTE_COLUMN_ALIASES = ["votes", "vote total", "valid votes", "total votes"]
CONTEST_COLUMN_ALIASES = ["contest id", "contest code"]
ACTOR_COLUMN_ALIASES = ["party id", "party code", "candidate id"]
VOTE_CSV_COLUMNS = [
    "Contest_ID", "Contest_Name", "Province_ID", "Province_Name", "Party_ID", "Party_Name", "Candidate_ID", "Candidate_Name", "Votes",
]

CONF_FULL_NAME, CONF_DISPLAY, CONF_SLUG, CONF_ALIAS, CONF_SURNAME = 0.99, 0.95, 0.93, 0.90, 0.72
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE, AMBIGUITY_MARGIN = 0.90, 0.72, 0.1
UNRESOLVED_FAIL_ABOVE, ORPHAN_WARN_PCT, ORPHAN_FAIL_PCT = 50, 10, 50
FAILED_RUN_DAYS, STALE_DAYS, STUCK_HOURS = 7, 7, 24
LAUNCH_COVERAGE_PCT = 80
MAX_SOURCES, MAX_EXCERPT, SNIPPET_RADIUS = 8, 260, 250
#: Most words of a question that are searched for; the published rule, apart from the number of sources shown.
MAX_TERMS = 8
# ---------------------------------------------------------------------------
