"""Recogniser patterns and word lists."""

# The categories in display order, and their precedence in overlaps.
CATEGORIES = ["PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "ORGANIZATION", "ADDRESS", "SSN", "CREDIT_CARD", "DATE_OF_BIRTH", "IP_ADDRESS"]
PRIORITY = {"EMAIL_ADDRESS": 1, "CREDIT_CARD": 2, "IP_ADDRESS": 3, "PHONE_NUMBER": 4, "SSN": 5, "DATE_OF_BIRTH": 6, "ADDRESS": 7, "ORGANIZATION": 8, "PERSON": 9}

# Patterns.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?\d{1,3}[\s-]?)?\(?\d{2,5}\)?[\s-]?\d{3,5}[\s-]?\d{3,5}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"(?<![0-9a-fA-F:])(?:[0-9a-fA-F]{1,4}:){1,7}[0-9a-fA-F]{1,4}(?![0-9a-fA-F:])|(?<![0-9a-fA-F:])(?:[0-9a-fA-F]{1,4}:)*::?(?:[0-9a-fA-F]{1,4}:)*[0-9a-fA-F]{1,4}(?![0-9a-fA-F:])"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
DOB_KEYWORD = r"(?i)\b(?:dob|date\s+of\s+birth|born\s+on|birth\s*date|age[:\s])\b"
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE = rf"(?i)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|\d{{1,2}}[\s/-]?{MONTH}[\s/-]?\d{{2,4}}|{MONTH}[\s/-]?\d{{1,2}},?[\s/-]?\d{{2,4}})\b"
ADDRESS_KEYWORD = r"(?i)\b(?:street|road|avenue|blvd|lane|plot|flat|house|building|suite|apartment|nagar|colony|marg|pin|zip|postal\s+code|po\s+box|district|state|andhra\s+pradesh|maharashtra|karnataka|delhi|mumbai|bangalore)\b"
ADDRESS = r"(?i)\b(?:\d{1,4}[,\s]+)?(?:[A-Z][a-z0-9\.]+[,\s]+){1,5}(?:Street|Road|Avenue|Lane|Nagar|Colony|Marg|District|State|Prakasam|Andhra Pradesh|Karnataka|Maharashtra|Delhi)(?:[,\s]+\d{5,6})?\b"
ORGANIZATION = r"(?i)\b[A-Z][A-Za-z0-9&\s]{1,40}\s+(?:Pvt\.?\s*Ltd\.?|Ltd\.?|Inc\.?|Corp\.?|Corporation|LLP|LLC|Labs|Technologies|Services)\b"
#: Persons after a cue word; this engine's own rule, where no entity model is plugged in.
CUE_PERSON = r"\b(?:by|Contact|contact|and|Dr\.|Mr\.|Ms\.|Mrs\.) [A-Z][a-z]+ [A-Z][a-z]+\b"
NAME = "[A-Z][a-z]+ [A-Z][a-z]+$"
#: What a text must hold for a pattern to hit it; cheaper to look for than the pattern.
ORGANIZATION_HINT = r"(?i)ltd|inc|corp|llp|llc|labs|technologies|services"
HEADINGS = "assignment:|assignment|background|task|deliverables|evaluation criteria|time to complete|recall:|precision:|code quality:|communication:|company|issuer|applicant|prospectus|red herring prospectus|order|ticket"

# Words that are no entity by themselves.
PERSON_STOP = ["Task", "Background", "Deliverables", "Time", "Recall", "Precision"]
ORG_STOP = "company|issuer|applicant|the company|pii|docx|readme|ssn|ip|json|html|css|api|url|pdf|vcf|assignment|requirements|ner".split("|")
GENERIC_LOCAL_PARTS = "support info admin contact sales help office billing".split()
GENERIC_WORDS = "pvt ltd inc corp llp llc limited co company labs technologies services solutions systems and the for group holdings enterprises international global national trust bank fund associates partners capital management financial advisors india private".split()
AREA_CODES = [212, 312, 415, 650, 206, 305, 408, 512]
TEST_NETS = ["192.0.2", "198.51.100", "203.0.113"]
SAFE_DOMAINS = ["example.com", "example.org", "example.test"]
