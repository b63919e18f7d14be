"""Rule tables of legal texts. The patterns, word lists and window widths here are fixed values that results depend on."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A shape: the region is the match or, with `last`, its last group, which must end the match."""

    pack: str
    tag: str
    pattern: str
    flags: str = ""
    last: bool = False


class Nominator(NamedTuple):
    """A pattern whose group is a name that is then masked wherever it stands in the document."""

    rail: str
    tag: str
    pattern: str
    flags: str = ""
    stop: tuple[str, ...] = ()


_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_NUMBER = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty(?:-\w+)?|thirty(?:-\w+)?|forty(?:-\w+)?|fifty(?:-\w+)?|\d{1,4})"
_COUNTED = "(?:co-?accused|accused|counts?|witness(?:es)?|children|accomplices?|defendants?|victims?|convictions?|offences?|charges?)"
_PLACE = r"[A-ZÀ-Þ][\w’'-]+(?:\s+[A-ZÀ-Þ][\w’'-]+)?"
KINSHIP = "(?:sons?|daughters?|father|mother|fathers|mothers|brothers?|sisters?|wife|wives|husbands?|spouses?|childr?e?n?|grandchildren|cousins?|uncles?|aunts?|nephews?|nieces?|parents?|stepfather|stepmother|widows?|widowers?)"
_DISABILITY = r"(?:disabled|disablement|invalid|paralysed|paralyzed|blind|deaf|amputat\w+|handicapp?ed)"

PACKS = (
    Rule("L1d", "[Date]", rf"\b(?:{_NUMBER})\s+(?:days?|weeks?|months?|years?)\b", "i"),
    Rule("L3", "[Amount]", r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"),
    Rule("L3", "[Amount]", r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|twelve|fifteen|twenty)\s+(?:years?|months?|weeks?|days?)(?:['’]s?)?\s+(?:imprisonment|detention|prison|custody)\b", "i"),
    Rule("L6", "[Amount]", rf"\b{_NUMBER}\s+(?:other\s+|prosecution\s+|defence\s+)?{_COUNTED}\b", "i"),
    Rule("L6", "[Amount]", rf"\b(?:at least\s+)?{_NUMBER}\s?(?:grams?|kilograms?|kilos?|litres?|liters?|tablets?|pills?)(?:\s+of\s+\w+(?:\s+\w+)?)?\b", "i"),
    Rule("L6", "[Amount]", r"\blife sentence of imprisonment\b|\blife imprisonment\b", "i"),
    Rule("L8", "[Job]", r"\b(?:owners? of|managers? of|directors? of|works?(?:ed|ing)? (?:at|in|for|as)|employed (?:as|by|at)|trained as|qualified as|practi[sc](?:ed|ing) as)\s+(?:a|an|the)?\s*[a-z][\w’'-]*(?:\s+[a-z][\w’'-]+){0,3}"),
    Rule("L9", "[Place]", rf"\b(?:lived|resided|residing|living|settled|born|arrested|detained|imprisoned|based|situated|located|schooled|hospitali[sz]ed)\s+(?:in|at|near)\s+(?:the\s+)?{_PLACE}"),
    Rule("L9", "[Place]", rf"\b(?:town|village|city|district|province|county|municipality|region) of\s+{_PLACE}"),
    Rule("L10", "[Code]", r"\b[A-Z]{2,4}[- ]\d{5,7}[- ]\d{4}\b"),
    Rule("L10", "[Dem]", r"\bin (?:his|her|their) (?:(?:early|mid|late) )?\d0s\b", "i"),
    Rule("L10", "[Dem]", r"\b(?:almost|about|around|nearly|over|under)?\s?\d{1,3} years? (?:old|of age)\b", "i"),
    Rule("L10", "[Dem]", r"\b\d{1,2} (?:weeks?|months?) and \d{1,2} days?\b", "i"),
    Rule("L11", "[Date]", r"\b(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\.?\s+\d{1,2},?\s+\d{4}\b"),
    Rule("L11", "[Date]", r"\b[a-z]+\s*\(\d+\)\s*(?:calendar\s+|business\s+)?(?:days?|months?|years?|weeks?)\b", "i"),
    Rule("L11", "[Date]", r"\b\d{1,3}-day\b", "i"),
    Rule("L11", "[Amount]", r"\b[\d,]{4,}\s+shares?\b", "i"),
    Rule("kinship-phrase", "[Dem]", r"\b(?:his|her|their)\s+(?:wife|husband|sons?|daughters?|mother|father|brothers?|sisters?|uncles?|aunts?|nieces?|nephews?|cousins?|grandmother|grandfather|widow|fiancée?)\b", "i"),
    Rule("dialect", "[Dem]", r"\b(?:Hokkien|Teochew|Cantonese|Hainanese|Hakka|Peranakan|Taoist|Buddhist|Hindu|Sikh|Roman Catholic|Methodist|Anglican)\b"),
    Rule("occupation", "[Job]", r"\b(?:(?:was|is|as|being)\s+(?:a|an|the)\s+|(?:work(?:s|ed|ing)?|employ(?:ed|s)?|serv(?:es|ed|ing)?)\s+as\s+(?:a|an|the)?\s*)((?:[a-z][\w-]*\s+){0,3}(?:jockey|accountant|teacher|driver|manager|nurse|engineer|cleaner|hawker|clerk|surgeon|technician|lecturer|professor|banker|contractor|salesman|businessman|shareholder|homemaker|housewife))\b", "i", True),
)
#: Shapes that count only where their surroundings let them; the guards are in operators.legal.
GUARDED = (
    Rule("app-number", "[Code]", r"\b\d{1,5}\/\d{1,4}\b"),
    Rule("relational", "[Dem]", rf"\b{KINSHIP}\b", "i"),
    Rule("L9w", "[Place]", r"\b(?:in|at|near|from) ([A-ZÀ-Þ][\w’'-]+)\b", "", True),
    Rule("L5-kin", "[Dem]", rf"\b{KINSHIP}\b", "i"),
    Rule("L5-disability", "[Dem]", rf"\b(?:partly |permanently |severely )?{_DISABILITY}\b", "i"),
    Rule("foreign", "[Misc]", r"[\wÀ-ÿĀ-ſƀ-ɏ]*[À-ÖØ-öø-ÿĀ-ſƀ-ɏ][\wÀ-ÿĀ-ſƀ-ɏ]*"),
)
OWN_NUMBER = r"application"
PRECEDENT_BEFORE, PRECEDENT_AFTER = r"v\.?\s+[^,]{1,40},\s*(?:nos?\.\s*)?$", r"^\s*,\s*§"
RELATIONAL_ANCHOR = r"\[(?:Person|Dem)\d*\]|applicant(?:s['’]?|['’]s)?|deceased|victim"
INSTITUTION_NEAR = r"\b(?:Court|Government|Ministry|Tribunal|Commission|Committee|Authorit|Prosecut|Board|Chamber|Police|Army|Parliament|Assembly|Convention|law|Act)\b"
TITLE_BEFORE = r"(?:Mr|Mrs|Ms|Judge|Justice|President|Registrar)\s+(?:[A-Z]\.\s*)*$"
NO_PLACE = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
    "Article", "Articles", "Section", "Chamber", "Court", "Convention", "Protocol", "Act", "Law", "Rule", "Rules", "Chapter",
    "Part", "Paragraph", "Annex", "Strasbourg", "Europe",
)
SECTION_HEAD = r"(?im)^(PROCEDURE|AS TO THE FACTS|THE FACTS|FACTS|THE CIRCUMSTANCES OF THE CASE|RELEVANT DOMESTIC LAW[^\n]*|AS TO THE LAW|THE LAW|LAW|FOR THESE REASONS|PROCEEDINGS[^\n]*)\s*(?=\n|$)"
FACTS = "FACTS|CIRCUMSTANCES"

#: Public bodies, within which nothing is masked, and the words that make a name institutional.
PUBLIC_BODY = (
    r"\b(?!(?:January|February|March|April|May|June|July|August|September|October|November|December|On|By|At|In)\b)[A-ZÀ-Þ][\w'’.-]*(?:\s+[\w'’.-]+){0,5}\s+"
    r"(?:Court|Courts|Tribunal|Prosecutor|Prosecution|Ministry|Government|Commission|Committee|Board|Agency|Authority|Office|Department|Directorate|Parliament|Assembly|Chamber|Registry|Ombudsman|Police|Council)\b"
    r"(?:\s+of\s+[A-ZÀ-Þ][\w'’-]*(?:\s+[A-ZÀ-Þ][\w'’-]*){0,3})?"
)
INSTITUTIONAL = r"\b(?:Court|Government|Commission|Committee|Chamber|Registry|Convention|Ministry|Tribunal|Council|Prosecutor|Republic|Kingdom|Parliament|Assembly|Bar Association|Court of Cassation|Constitutional Court)\b"
INSTITUTIONAL_WIDE = rf"{INSTITUTIONAL}|\b(?:Board|Agency|Authority|Office|Department|Ombudsman|Directorate)\b"
GLOSSED = "(?:Court|Courts|Tribunal|Prosecutor|Ministry|Government|Commission|Committee|Board|Agency|Authority|Office|Department|Directorate|Parliament|Assembly|Chamber|Registry|Ombudsman|Police|Council)"
GLOSS = (
    rf"{GLOSSED}[^(\n]{{0,40}}\(\s*(?:the\s+)?([^)]{{3,50}}?)\s*(?:[–—-][^)]*)?\)",
    rf"\b([\wÀ-ÿĀ-ſ'’ -]{{3,50}}?)\s*\([^)]{{0,40}}{GLOSSED}[^)]{{0,40}}\)",
)
GLOSS_STOP = ("the", "and", "of", "in", "for", "hereinafter", "referred", "to", "as")
GLOSS_PROSE = ("subsequently", "requested", "received", "following", "application", "applicant", "government", "however", "therefore", "pursuant", "whereas", "hereinafter")
RESPONDENT = r"application[^.]{0,120}?against\s+(?:the\s+)?([A-Z][^.]{2,90}?)(?:\s+lodged|\s+\(|,|\.|\s+under)"

#: What comes back: judicial titles before a name, initials that are anonymous already, organs of the deciding court.
OFFICIAL_TITLE = r"(?:Judges?|Justice|Mr\s+Justice|Mrs\s+Justice|Registrar|Deputy\s+Registrar|Advocate\s+General|Judge\s+Rapporteur)[\s,]{0,3}$"
OFFICIAL_TITLE_WIDE = r"(?:Judges?|Justice|Mr\s+Justice|Mrs\s+Justice|Registrar|Deputy\s+Registrar|Advocate\s+General|Judge\s+Rapporteur|Circuit\s+Judge|District\s+Judge|Chief\s+Justice|Senior\s+Judge|Magistrate|Justice\s+of\s+Appeal|Judicial\s+Commissioner|The\s+Honou?rable)[\s,]{0,3}$"
PRE_ANONYMOUS = r"^(?:(?:Mr|Mrs|Ms|Dr)\.?\s+)?[A-Z](?:\.[A-Z])?\.?$"
ORGAN = r"\b(?:European Court of Human Rights|European Commission of Human Rights|Grand Chamber|Committee of Ministers|the Convention|the Court|the Commission|the Chamber|the Registry)\b"
OWN_CASE = r"(\[Person\d+\])\s+v\.\s+[A-ZÀ-Þ][\w'’-]+(?:\s+[A-ZÀ-Þ][\w'’-]+)?"

NICKNAME_STOP = tuple(
    "The This That These Those Court Judge Justice Wife Husband Child Children Father Mother Order Orders Act Section Family Division "
    "Singapore High Appeal Counsel Plaintiff Defendant January February March April May June July August September October November "
    "December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Affidavit Agreement Matrimonial Assets Consent Summons Notice "
    "Rules Chapter Part Article Exhibit Annex Schedule God Christmas Chinese English Malay Indian".split()
)
NOMINATORS = (
    Nominator("quoted-variant", "[Person]", r"""(?:names?|spell(?:ed|s|ing)?|known\s+as|a\/k\/a|aka|alias|referred\s+to\s+as)\s*[,:]?\s*[“"‘']([A-Z][\w'’-]{1,20})[.,]?[”"’']""", "i"),
    Nominator("kinship-name", "[Person]", r"\b(?:sons?|daughters?|wife|husband|brothers?|sisters?|mother|father|nephews?|nieces?|cousins?|grandsons?|granddaughters?)\s*,\s*([A-Z][\w'’-]{1,15})\s*,"),
    Nominator("nickname", "[Person]", r"""[A-Z][\w'’-]+(?:\s+[A-Z][\w'’-]+){1,4}\s+[“"']([A-Z][a-z]{2,15})[”"']""", "", NICKNAME_STOP),
    Nominator("account", "[Id]", r"\baccounts?(?:\s+(?:number|nos?\.?))?\s+ending\s+(?:in|with)\s+(\d{3,6})\b", "i"),
)
FIRM_LIST = r"\b([A-Z][\w'’-]+(?:\s*,\s*[A-Z][\w'’-]+)+\s*&\s*[A-Z][\w'’-]+)\s*,?\s*(?:LLP|L\.L\.P\.|LLC|PLLC|P\.C\.|PA\b)"
DEFINED_ALIAS = r"""([A-Z][\w'’.-]+(?:\s+[A-Z][\w'’.@-]+|\s+(?:s\/o|d\/o|bin|binte)\s+[A-Z][\w'’.-]+){0,4})\s*\(\s*[“"‘']((?:the\s+)?[A-Z][\w'’ .&-]{1,25}?)[”"’']\s*\)"""
ALIAS_STOP = r"^(?:Agreement|Act|Court|Convention|Company|Contract|Parties|Party|Rules?|Judgment|Defendant|Plaintiff|Claimant|Respondent|Applicant|Appellant|Executive|Employee|Employer|Board|Bank|Landlord|Tenant|Buyer|Seller|Vendor|Purchaser|Licensee|Licensor|Guarantor|Borrower|Lender|Trustee|Owner|Operator|Manager|Contractor|Consultant|Supplier|Customer|Distributor|Group|Holder|Investor|Member|Partner|Shareholder|Subsidiary|Affiliate|Government|State|Region|City|Effective Date|Closing Date|Term)$"
QUOTED_INITIALS = r"""[(]\s*[“"‘']([A-Z]{2,4})[”"’'][\s)]"""
NAME_RUN = r"(?:[A-Z][\w'’-]+\s+){1,4}[A-Z][\w'’-]+"
INITIALS_STOP = tuple(
    "AND THE FOR NOT ALL ANY GST CPF SGX USA LLP LLC PTE LTD INC USD SGD EUR GBP CJ JA JC SC QC DPP HDB URA MRT UEN PDF NO NOS ACT CAP "
    "AG SE NV BV SA AB OY PLC CEO CFO COO CTO EVP SVP VP GC HR IT IP PC PA".split()
)
SURNAME_STOP = r"^[a-z]|^(?:Mr|Mrs|Ms|Dr|Mdm|Tan)$"
#: Captions: characters read, party shapes, and what is no person.
CAPTION_ZONE, TITLE_ZONE, LINE_ZONE, CAPTION_LINES = 3000, 400, 3500, 7
CAPTION_PARTIES = (
    r"\b(?:Between|And)\s+((?:[A-Z][\w'’@.-]+)(?:\s+(?:[A-Z][\w'’@.-]+|s\/o|d\/o|bin|binte|@)){1,6})\s*(?:…|\.\.\.|\n|,|\()",
    r"\b((?:[A-Z][\w'’.-]+)(?:\s+[A-Z][\w'’.-]+){1,4}),\s*(?:Plaintiffs?|Defendants?|Appellants?|Appellees?|Petitioners?|Respondents?)\b",
)
CAPTION_PUBLIC = r"\b(?:Public Prosecutor|Attorney|United States|State|Government)\b"
TITLE_LINE = r"(?m)^Title:\s*(.{3,140})(?=\n|$)"
TITLE_PARTY = r"^(?:[A-Z][\w'’.-]*)(?:\s+[A-Z][\w'’.-]*){0,3}$"
LINE_PARTY = r"^(?:[A-Z][\w'’@.-]+|s\/o|d\/o|bin|binte|@)(?:\s+(?:[A-Z][\w'’@.-]+|s\/o|d\/o|bin|binte|@)){0,5}$"
PARTY_STOP = r"\b(?:United States|of America|State|People|Commonwealth|Public Prosecutor|Attorney-?General|Government|In re|Matter of|Ex parte)\b"
CORPORATE = r"\b(?:Inc|Ltd|Limited|Corp|Corporation|Co|Company|LLC|LLP|Pte|Pty|PLC|GmbH|Association|Bank|Insurance|University|College|City|County|Board|Commission|Department|Agency|Authority|Fund|Trust|Group|Holdings|Partners?|Services|Systems|Industries|International|Airlines|Hospital)\b|&"
CAPTION_ROLE = r"^(?:Claimants?|Defendants?|Plaintiffs?|Applicants?|Respondents?|Appellants?|Appellees?|Petitioners?|Intervener?s?|…|\.\.\.|Grounds of Decision|Judgment|Between|And|and)$"
PARTY_NAME = r"[A-Z][\w'’.-]+(?:\s+[A-Z][\w'’.-]+){0,3}"
CITE_TAIL = r"^[\s,]*\d{1,4}\s+[A-Z][A-Za-z0-9. ]{0,16}?\d{1,5}\s*(?:\([^)\n]{0,45}\))?"
PARTY_CODE_ZONE = 2000
PARTY_CODE = r"\b(?:Between|And|and)\s+((?:[A-Z]{1,3})(?:\s+[A-Z]{1,3})?)\s*(?:\n|…|\()"
PARTY_CODE_STOP = ("AND", "THE", "FOR", "SGX", "GST", "CPF")
REGISTER = r"\b(?:OA|OS|SUM|HC\/SUM|CA\/OA|AD\/OA|DC|MC|MA|CR|CC|RA|OC|SOP(?:\/AA)?|AA)\s?\d{1,5}\b|\bSuit\s+\d{1,5}\s+of\s+\d{4}\b"
LETTER_CAPTION, BRACKETED, CROSSED = r"\b[A-Z]{1,4}\s+v\s+[A-Z]{1,4}\b", r"\[[A-Z][A-Za-z0-9 ]{0,18}\]", "X{3}"

#: Precedent: reports, the triple of volume, report and page, the names around a "v.", and what may follow.
_REPORT = r"(?:F\.\s?(?:2d|3d|4th)|F\.\s?App['’]x|F\.\s?Supp\.(?:\s?2d|\s?3d)?|U\.\s?S\.|S\.\s?Ct\.|L\.\s?Ed\.(?:\s?2d)?|A\.(?:2d|3d)|N\.E\.(?:2d|3d)|N\.W\.(?:2d|3d)|N\.Y\.S\.(?:2d|3d)|P\.(?:2d|3d)|S\.E\.(?:2d|3d)|S\.W\.(?:2d|3d)|So\.(?:\s?2d|\s?3d)?|B\.R\.|Fed\.\s?Cl\.|T\.C\.|WL|LEXIS)"
_CITE = rf"\d{{1,4}}[ \t\n]+{_REPORT}[ \t\n]+(?:at[ \t\n]+)?\*?\d{{1,7}}"
_CITED_WORD = r"(?:[A-Z][\w&'’.-]{0,30}|of|the|and|de|van|von|ex|rel\.|&)[,]?"
_CITED_NAME = rf"{_CITED_WORD}(?:[ \t\n]+{_CITED_WORD}){{0,9}}"
_DOCKET = r"(?:Nos?\.[ \t\n]*[^,\n]{1,45},[ \t\n]*)?"
_PAGES = r"(?:,[ \t\n]*\*?\d{1,5}(?:[ \t\n]*[-–][ \t\n]*\d{1,5})?)?(?:,?[ \t\n]*at[ \t\n]+\*?\d{1,4}(?:[ \t\n]*[-–][ \t\n]*\d{1,4})?)?(?:[ \t\n]*\([^)\n]{0,70}\))?"
FULL_CITE = rf"\b({_CITED_NAME})[ \t\n]+v\.?[ \t\n]+({_CITED_NAME})[ \t\n]*{_DOCKET}({_CITE}){_PAGES}"
SHORT_CITE = rf"\b([A-Z][\w'’-]{{2,25}}),[ \t\n]+({_CITE}){_PAGES}"
IDENTITY_STOP = tuple(
    "inc inc. ltd ltd. llc llp plc pte pty corp corp. co co. company companies group holdings holding trust fund funds bank banks the and "
    "of et al al. no nos united states america american court courts city county board commission department district sec sec. securities "
    "partners partnership associates services service systems international global markets market capital management industries enterprises "
    "solutions technologies products limited incorporated firm law legal".split()
)
#: Federal captions: a line with a role, lines of the court, and what follows a party's name.
US_ZONE, US_LINES = 4000, 4
US_ROLE = r"^[\s)(|]*(?:Plaintiffs?|Defendants?|Petitioners?|Respondents?|Appellants?|Appellees?|Claimants?|Debtors?(?:[- ]in[- ]Possession)?|Movants?|Applicants?|Intervenors?|Counter-?(?:Plaintiffs?|Defendants?|Claimants?)|Cross-?(?:Plaintiffs?|Defendants?)|Third-?Party (?:Plaintiffs?|Defendants?))[\s,.;:)(|]*$"
US_VENUE = r"\b(?:UNITED STATES|DISTRICT COURT|DISTRICT OF|IN THE|FOR THE|SUPERIOR COURT|BANKRUPTCY COURT|COURT OF|COUNTY OF|STATE OF|COMMONWEALTH OF|Case No|Civil Action|Adversary|Chapter \d|Judge|Magistrate|Honorable|Hon\.)\b|^[Xx\-_=*\s.)(|]{4,}$|^\s*v\.?\s*$"
US_DESCRIPTOR = r",\s*(?:a|an|the)\s+[a-z][^,]{0,60}$"
US_RE_LINE = r"(?m)^[ \t]*Re:[ \t]*([^\n]{3,160}?)[ \t]*(?=\n|$)"
CORPORATE_END = r"[,\s]+(?:Inc|Ltd|Limited|Corp|Corporation|Co|Company|LLC|L\.L\.C|LLP|PLC|Pte|Pty|GmbH|N\.V|B\.V|S\.A)\.?$"
ACRONYM_STOP = tuple(
    "ECF USDC CMECF LLC LLP PLC INC LTD PTE PTY CIV USC CFR FRCP FRE USA PDF AND THE FOR NOT ALL ANY PER SEE NEW YORK CPL JD ESQ PLLC NO "
    "NOS PAGE CASE DOC EXHIBIT ORDER DATED FILED SDNY EDNY NDNY WDNY CACD CDCA TXWD WDOK OKWD FLSB USDJ USMJ IT IS SO OF IN ON AT BY TO RE".split()
)
