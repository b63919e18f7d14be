"""Rule tables as data. The patterns, word lists and weights here are fixed values that results depend on."""

from __future__ import annotations

#: (pattern, flags, mark): structured identifiers, masked in this order, each over the result of the last.
FLOOR = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "", "[email]"),
    (r"\b[STFGM] ?\d{7} ?[A-Z]\b", "i", "[nric]"),
    (r"\b(?:\d[ .-]?){13,16}\b", "", "[card]"),
    (r"(?:\+?65[\s-]?)?[689]\d{3}[\s-]?\d{4}\b", "", "[phone]"),
    (r"\b\d{9,16}\b", "", "[number]"),
)
#: What every match of each rule of the floor holds, and no mark does.
FLOOR_NEEDS = ("@", *[r"[0-9](?:[ .-]?[0-9]){3}"] * 4)

EMAIL = FLOOR[0][0]
URL = r"""(?:https?://|www\.)[^\s"'<>()]+|\b(?:[a-z0-9][a-z0-9-]*\.)+(?:com(?:\.sg|\.au)?|co\.uk|com|net|org|io|sg|biz)\b"""
_SUFFIX = "(?:University|College|Institute|Institutes|School|Academy|Association|Society|Foundation|Conservatory|Seminary|Polytechnic)"
_INST = "[A-Z][A-Za-z&.'’-]+"
_AMP = "[A-Z][A-Za-z.'’-]+"

#: (rail, class, pattern, flags, group), in order of precedence; a pattern later in a rail comes later too.
RAILS = (
    ("phone", "PHONE", r"\(\d{3}\)\s?\d{3}[-.\s]\d{4}", "", 0),
    ("phone", "PHONE", r"\b\d{3}[-./]\d{3}[-.]\d{4}\b", "", 0),
    ("phone", "PHONE", r"\+\d{1,3}[\s-]?\d{1,4}(?:[\s-]\d{2,5}){1,4}", "", 0),
    ("id", "ID", r"\b\d{2}-\d{7}\b", "", 0),
    ("id", "ID", r"\b\d{3}-\d{2}-\d{4}\b", "", 0),
    ("id", "ID", r"\b\d{3}-\d{6}\b", "", 0),
    ("id", "ID", r"\b\d{8,9}[A-Z]\b", "", 0),
    ("id", "ID", r"\((?:NASDAQ|Nasdaq|NYSE|AMEX|SGX|LSE|ASX|OTC[A-Z]*|Pink\s+Sheets)\s*:\s*[A-Z0-9.]{1,8}\)", "", 0),
    ("id", "ID", r"\b\d{2}/\d{3},\d{3}\b", "", 0),
    ("id", "ID", r"\bPCT/[A-Z]{2}\d{4}/\d{6}\b", "", 0),
    ("id", "ID", r"\b\d{4}-\d{6}\b", "", 0),
    ("id", "ID", r"\bPCAOB\s+(?:ID\s+)?(?:No\.?:?\s*)?\d{3,5}\b", "i", 0),
    ("id", "ID", r"\b(?:Commission\s+)?File\s+(?:No\.?|Number)[:\s]*\d{1,3}-\d{4,6}\b", "i", 0),
    ("id", "ID", r"\b\d-\d{7}-\d\b", "", 0),
    ("id", "ID", r"\b\d{1,4}\s+(?:F\.\s?(?:2d|3d|4th)|U\.S\.|S\.\s?Ct\.|F\.\s?Supp\.\s?(?:2d|3d)?)\s+\d{1,5}\b", "", 0),
    ("id", "ID", r"\[\d{4}\]\s+SG[A-Z]{2,4}\s+\d{1,5}\b", "", 0),
    ("id", "ID", r"\b(?:Civil\s+Appeal|Originating\s+(?:Claim|Summons|Application)|Suit|Bill\s+of\s+Costs)\s+No\.?\s+\d{1,5}\s+of\s+\d{4}\b", "i", 0),
    ("id", "ID", r"\b(?:HC|CA|AD|DC|MC)/(?:OC|OA|OS|SUM|RA|RAS|SIC|S|CA)\s*\d{1,5}/\d{4}\b", "", 0),
    ("id", "ID", r"\bRegistrar['’]s\s+Appeals?\s+Nos?\.?\s+\d{1,5}(?:\s+and\s+\d{1,5})?\s+of\s+\d{4}\b", "i", 0),
    ("id", "ID", r"\bFR\s+Doc\.\s*\d{4}-\d{4,6}\b", "", 0),
    ("id", "ID", r"\b\d{1,3}\s+FR\s+\d{3,6}\b", "", 0),
    ("id", "ID", r"\b\d{1,3}\s+CFR\s+\d{1,4}(?:\.\d{1,4}(?:-\d{1,3})?)?\b", "", 0),
    ("id", "ID", r"\b\d{1,3}\s+U\.S\.C\.\s+\d{1,6}[a-z]?\b", "", 0),
    ("id", "ID", r"\bPub\.\s*L\.\s*\d{2,3}-\d{1,4}\b", "", 0),
    ("id", "ID", r"\bBILLING\s+CODE\s+[\dA-Z-]{4,12}\b", "", 0),
    ("id", "ID", r"\b\d{1,3}\s+Statutes\s+at\s+Large,?\s+\d{1,5}\b", "i", 0),
    ("id", "ID", r"\bFORM\s+\d{1,2}-[A-Z]{1,3}(?:/A)?\b", "i", 0),
    ("id", "ID", r"\b(?:NYSE|NASDAQ|Nasdaq|AMEX|LSE|SGX|ASX):\s?[A-Z]{1,6}(?:\.[A-Z]{1,3})?\b", "", 0),
    ("id", "ID", r"\b[A-Z]{2,4}/\d{4,9}-\d{3,9}(?:/\d{4,12}v\d{1,3})?\b", "", 0),
    ("id", "ID", r"\b[a-z]{2,6}-\d{8}\b", "", 0),
    ("signature", "PERSON", r"/s/\s*[A-Z][A-Za-z.'’-]+(?:[ ]+[A-Z][A-Za-z.'’-]+){0,3}", "", 0),
    ("institution", "COMPANY", rf"\b(?:{_INST}\s+){{1,4}}{_SUFFIX}(?:\s+of\s+{_INST}(?:\s+{_INST}){{0,3}})?", "", 0),
    ("institution", "COMPANY", rf"\b{_SUFFIX}\s+of\s+{_INST}(?:\s+{_INST}){{0,3}}", "", 0),
    ("institution", "COMPANY", rf"\b(?:{_INST}\s+){{1,4}}(?:Chamber\s+of\s+Commerce|Research\s+Complex)", "", 0),
    ("header-meta", "ID", r"\bCAP\s+id\s+\d{4,10}\b", "", 0),
    ("header-meta", "ID", r"\bSource:\s*Caselaw\s+Access\s+Project[^\n]{0,40}", "", 0),
    ("header-meta", "ID", r"\bEX(?:HIBIT)?[-\s]?\d{1,3}\.\d{1,2}\b", "i", 0),
    ("header-meta", "ID", r"\b[a-z0-9_-]{2,40}_?ex[\d_d-]{1,10}\.htm\b", "i", 0),
    ("header-meta", "ID", r"\b[a-z0-9_-]{4,40}_(?:8k|10k|10q|6k|s1|def14a)[a-z0-9]{0,6}\.htm\b", "i", 0),
    ("header-meta", "ID", r"\b\d{10}-\d{2}-\d{6}\b", "", 0),
    ("amp-name", "COMPANY", rf"\b(?:{_AMP},?\s+){{1,4}}(?:&|&amp;)\s+{_AMP}(?:\s+(?:LLP|LLC|L\.L\.P\.|Inc\.?|Co\.?|Ltd\.?|Company|Sons(?:\s+Limited)?))?", "", 0),
    ("platform", "BRAND", r"\b(?:LinkedIn|YouTube|Facebook|Instagram|TikTok|WhatsApp|Telegram|WeChat)\b", "", 0),
    ("known-name", "BRAND", r"Wi-Fi(?:\s+\d[A-Za-z]?)?", "", 0),
    ("known-name", "BRAND", r"Bluetooth(?:\s+(?:Low\s+Energy|\d(?:\.\d)?))?", "", 0),
    ("known-name", "BRAND", r"\b(?:UWB|Zigbee|LoRa|Apple|Google|Microsoft|Amazon|Nvidia|Intel|Samsung|Oracle|IBM)\b", "", 0),
)

#: Rails that take a captured group, or look around what they match.
DEFINED_TERM = r'\(\s*(?:the\s+)?["“]([A-Z][A-Za-z0-9 .&/\'’-]{1,40}?)["”]\s*\)'
MARK = r"((?:[A-Z][A-Za-z'’-]*[ ]?){1,3})\s?[®™]"
XBRL = r"\b([A-Za-z][A-Za-z0-9-]*):([A-Za-z0-9.]+(?:Member|Axis|Domain))\b"
XBRL_STANDARD = ("us-gaap", "dei", "srt", "xbrli", "iso4217", "country", "stpr", "naics", "sic", "currency", "exch", "fasb", "xbrl", "link", "xlink")
QUOTED_ORG = r'["“]([A-Z][A-Za-z0-9&.\'’-]*(?:\s+(?:of|and|for|the|[A-Z][A-Za-z0-9&.\'’-]*)){2,7})["”]\s*\(\s*["“]([A-Z][A-Za-z0-9]{1,20})["”]\s*\)'
ADDRESSES = (
    r"(?<![\d.])\d{1,5}\s+(?:[A-Z][A-Za-z.]*\s+){1,4}(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Highway|Hwy\.?|Drive|Dr\.?|Lane|Ln\.?|Boulevard|Blvd\.?|Way|Court|Ct\.?|Place|Pl\.?)\b(?:,\s*[A-Z][A-Za-z]+(?:,\s*[A-Z][A-Za-z]+)?)?",
    r"(?<![\d.])\d{1,5}\s+(?:[A-Z]{2,}[A-Za-z.]*\s+){1,4}(?:STREET|ST\.?|AVENUE|AVE\.?|ROAD|RD\.?|HIGHWAY|HWY\.?|DRIVE|DR\.?|LANE|LN\.?|BOULEVARD|BLVD\.?|WAY|COURT|CT\.?|PLACE|PL\.?)\b(?:,\s*(?:SUITE|STE\.?|UNIT)\s*\d+)?(?:,\s*[A-Z][A-Za-z.]*(?:\s[A-Z][A-Za-z.]*)?)?",
    r"\b[A-Z][A-Za-z.]+(?:\s[A-Z][A-Za-z.]+)?[,.]\s*(?:[A-Z]{2}|D\.C\.|[A-Z][a-z]+)\s+\d{5}(?:-\d{4})?\b",
    r"\bSingapore\s+\d{6}\b",
    r"#\d{2}-\d{2,3}\b",
    r"(?<![\d.])\d{1,5}\s+(?:Highway|Hwy\.?|Route|Rte\.?)\s+\d{1,3}(?:\s+(?:North|South|East|West|N|S|E|W))?\b",
)
TAG_TAIL = r"\[(?:Person|Company|Brand|Address|Email|Phone|Id)\d+\][,.]?\s*((?:[A-Z][A-Za-z.]*[,.]?\s+){0,2}\d{5,6}(?:-\d{4})?)(?![\d-])"

#: Words that never are a table entry by themselves.
FOOTPRINT_STOP = (
    "he she it its his her hers him they them their theirs we us our ours you your yours i me my mine "
    "the a an and or of in on at to for with from by as is are was were be been being this that these those "
    "other others another some any all each both into out over under more most less not no yes but if then than such per via"
).split()
PREFIX_STOP = ("the", "a", "an", "of", "and", "for", "de", "la", "first", "new", "united")
#: Words that TF-IDF leaves out.
TERM_STOP = (
    "the a an and or but if then of to in on at by for with from as is are was were be been being "
    "this that these those it its he she his her they them their we you your i not no nor so such "
    "do does did done have has had having will would shall should can could may might must than "
    "there here when where which who whom what why how all any both each few more most other some "
    "own same too very just also into over under again further once about against between through "
    "during before after above below up down out off only because while until upon within without "
    "per said one two three patient history normal noted well see"
).split()

MASK_TAG = r"\[(?:Person|Company|Brand|Address|Email|Phone|Id)\d+\]|\[(?:email|nric|card|phone|number)\]"
BARE_TAG = r"^(?:Person|Company|Brand|Address|Email|Phone|Id)\d+$"

#: (pattern, weight): surfaces that a thousand words are scored by.
DENSITY = (
    (r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", 1),
    (r"\b[\w.+-]+@[\w-]+\.\w+\b", 8),
    (r"\b\d{3}-\d{2}-\d{4}\b", 10),
    (r"\b[STFG]\d{7}[A-Z]\b", 10),
    (r"\b\d{6,10}[A-Z]?\b", 2),
    (r"\(\d{3}\)\s?\d{3}-\d{4}|\+65\s?\d{4}\s?\d{4}", 8),
    (r"\$\s?[\d,]{4,}|S\$\s?[\d,]{4,}", 3),
    (r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b|\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}\b", 2),
)

#: National numbers: prefixes that are issued, or never were.
EIN_NEVER = ("00", "07", "08", "09", "17", "18", "19", "28", "29", "49", "69", "70", "78", "79", "89", "96", "97")
NINO_NEVER = ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")

#: (pattern, canonical form) of law reports, by reporter and by series; the first that fits names it.
REPORTERS = (
    (r"U\.\s?S\.(?!\s?C)", "U.S."),
    (r"S\.\s?Ct\.", "S.Ct."),
    (r"L\.\s?Ed\.\s?2d", "L.Ed.2d"),
    (r"L\.\s?Ed\.", "L.Ed."),
    (r"F\.\s?Supp\.\s?2d", "F.Supp.2d"),
    (r"F\.\s?Supp\.", "F.Supp."),
    (r"F\.3d", "F.3d"),
    (r"F\.2d", "F.2d"),
    (r"Fed\.\s?Appx\.", "Fed.Appx."),
    (r"F\.\s?R\.\s?D\.", "F.R.D."),
    (r"B\.\s?R\.", "B.R."),
    (r"N\.\s?E\.\s?2d", "N.E.2d"),
    (r"N\.\s?W\.\s?2d", "N.W.2d"),
    (r"S\.\s?E\.\s?2d", "S.E.2d"),
    (r"S\.\s?W\.\s?[23]d", "S.W.2d"),
    (r"So\.\s?[23]d", "So.2d"),
    (r"P\.\s?[23]d", "P.2d"),
    (r"A\.\s?[23]d", "A.2d"),
    (r"Cal\.\s?Rptr\.\s?[23]d", "Cal.Rptr."),
)
SERIES = (
    (r"SGCA\s?\(I\)", "SGCA(I)"),
    (r"SGHC\s?\(I\)", "SGHC(I)"),
    (r"SGHC\s?\(A\)", "SGHC(A)"),
    ("SGHCF", "SGHCF"),
    ("SGHCR", "SGHCR"),
    ("SGCA", "SGCA"),
    ("SGHC", "SGHC"),
    ("SGDC", "SGDC"),
    ("SGMC", "SGMC"),
    ("SGFC", "SGFC"),
    (r"SLR\s?\(R\)", "SLR(R)"),
    ("SLR", "SLR"),
    ("MLJ", "MLJ"),
    ("UKSC", "UKSC"),
    ("UKHL", "UKHL"),
    ("UKPC", "UKPC"),
    (r"EWCA\s+Civ", "EWCA Civ"),
    (r"EWCA\s+Crim", "EWCA Crim"),
    ("EWHC", "EWHC"),
    (r"All\s+ER", "All ER"),
    (r"Lloyd['’]s\s+Rep", "Lloyd's Rep"),
    ("WLR", "WLR"),
    ("AC", "AC"),
    ("QB", "QB"),
    ("KB", "KB"),
    ("Ch", "Ch"),
    ("HKCFAR", "HKCFAR"),
    ("HKCFA", "HKCFA"),
    ("HKCA", "HKCA"),
    ("HCA", "HCA"),
    ("NZSC", "NZSC"),
    ("NZCA", "NZCA"),
)
SIGNAL = r"\b(but\s+see|but\s+cf\.|contra|see\s+also|accord|compare|citing|quoting|cf\.|e\.g\.|see)(?=[\s,])"
TREATMENT = r"\b(overruled|abrogated|superseded|reversed|vacated|rejected|criticized|distinguished|called\s+into\s+doubt)(?:\s+in\s+part)?\s+(?:by|in)\b"
PARALLEL_GAP = r"^\s*,(?:\s*\d+(?:\s*[-–—]\s*\d+)?(?:\s*&?\s*nn?\.\s*\d+(?:\s*[-–—]\s*\d+)?)?\s*,)*\s*$"
CERT = r"cert\.?\s+(?:denied|granted|dismissed)[,.]?\s*(?:[—–-]+\s*U\.?\s?S\.?\s*[—–-]+,?\s*)?$"
