"""Fixed values that results must agree on: keyword rules, place names, sites, hint words, patterns.

Everything here is data. Each operator takes such values as parameters and uses these by default.
"""

# --- fixed values: category keywords, weighted version ------------------------------------------
# One table per tier; the order of the categories in PRIMARY decides ties.

PRIMARY = {
    "Finance & Banking": ["accountant", "accounting", "finance", "financial", "audit", "auditor", "banking", "economist", "treasurer", "cashier", "bookkeeper", "payroll", "tax", "budget", "accounts", "financial analyst", "credit analyst", "loan officer", "investment"],
    "IT & Technology": ["developer", "programmer", "software engineer", "IT", "system administrator", "network", "database", "web developer", "cybersecurity", "data scientist", "technical support", "IT support", "software", "hardware"],
    "Healthcare": ["nurse", "doctor", "medical", "physician", "dentist", "pharmacist", "therapist", "medical officer", "health officer", "radiographer", "lab technician", "midwife"],
    "Education & Training": ["teacher", "instructor", "lecturer", "professor", "tutor", "trainer", "educational", "academic", "facilitator", "principal", "headmaster"],
    "Sales & Marketing": ["sales", "marketing", "sales representative", "marketing manager", "business development", "sales executive", "marketing officer", "brand manager", "sales manager"],
    "Human Resources": ["human resources", "HR", "recruitment", "hr officer", "hr manager", "talent acquisition", "personnel", "hr specialist"],
    "Engineering": ["engineer", "engineering", "mechanical engineer", "electrical engineer", "civil engineer", "project engineer", "maintenance engineer", "technical engineer"],
    "Administration": ["administrator", "admin", "secretary", "clerk", "assistant", "receptionist", "administrative assistant", "office manager", "data entry", "filing clerk"],
    "Management": ["manager", "director", "supervisor", "head", "chief", "executive", "team leader", "senior manager", "general manager", "operations manager"],
    "Legal": ["lawyer", "attorney", "legal officer", "paralegal", "legal advisor", "legal counsel", "compliance officer"],
    "Agriculture": ["agriculture", "farming", "farmer", "agricultural", "veterinary", "agronomy", "extension officer", "livestock"],
    "NGO & Development": ["NGO", "development", "project officer", "program officer", "community", "humanitarian", "volunteer", "nonprofit"],
    "Consulting": ["consultant", "consulting", "advisory", "specialist", "freelance", "contractor", "expert"],
    "Transportation & Logistics": ["driver", "transport", "logistics", "delivery", "shipping", "warehouse", "supply chain", "distribution"],
    "Security": ["security", "guard", "security guard", "protection", "surveillance"],
}

SECONDARY = {
    "Finance & Banking": ["financial statements", "general ledger", "accounts receivable", "accounts payable", "bank", "credit", "loan", "investment", "portfolio", "risk management"],
    "IT & Technology": ["programming", "coding", "javascript", "python", "java", "html", "css", "sql", "cloud", "server", "network security", "application", "digital", "technology"],
    "Healthcare": ["patient", "treatment", "clinical", "healthcare", "medical", "hospital", "clinic", "pharmacy", "nursing", "health", "diagnosis"],
    "Education & Training": ["education", "training", "school", "university", "curriculum", "learning", "student", "teaching", "classroom", "academic"],
    "Sales & Marketing": ["customer", "client", "promotion", "advertising", "brand", "retail", "commercial", "revenue", "target", "campaign", "market"],
    "Human Resources": ["employee", "benefits", "compensation", "workforce", "people", "talent", "recruitment", "hiring", "personnel"],
    "Engineering": ["mechanical", "electrical", "civil", "construction", "maintenance", "repair", "installation", "infrastructure", "technical"],
    "Administration": ["office", "administrative", "support", "filing", "coordination", "clerical", "reception"],
    "Management": ["leadership", "management", "operations", "strategic", "planning", "oversight", "coordination"],
    "Legal": ["legal", "law", "court", "judicial", "compliance", "contract", "litigation", "regulation"],
    "Agriculture": ["crop", "livestock", "irrigation", "rural", "farming", "agricultural"],
    "NGO & Development": ["social", "charity", "aid", "relief", "donor", "grant", "development"],
    "Consulting": ["consultancy", "expertise", "advisory", "specialist"],
    "Transportation & Logistics": ["fleet", "cargo", "transportation", "logistics", "shipping"],
    "Security": ["safety", "risk", "emergency", "security"],
}

COMPANY = {
    "Finance & Banking": ["bank", "financial", "finance", "credit", "investment", "insurance"],
    "IT & Technology": ["tech", "software", "IT", "digital", "computer", "technology"],
    "Healthcare": ["hospital", "clinic", "medical", "health", "pharmaceutical"],
    "Education & Training": ["school", "university", "college", "education", "training"],
    "Sales & Marketing": ["retail", "marketing", "sales", "commercial"],
    "Human Resources": ["hr", "human resources", "recruitment"],
    "Engineering": ["engineering", "construction", "manufacturing", "industrial"],
    "Legal": ["law firm", "legal", "court"],
    "Agriculture": ["agricultural", "farming", "livestock"],
    "NGO & Development": ["NGO", "foundation", "trust", "nonprofit", "charity"],
    "Consulting": ["consulting", "advisory"],
    "Transportation & Logistics": ["transport", "logistics", "shipping", "delivery"],
    "Security": ["security"],
}

EXCLUSIONS = {
    "Finance & Banking": ["software", "system development", "programming", "IT support"],
    "IT & Technology": ["accounting software", "financial system", "payroll system"],
    "Engineering": ["software engineer", "IT engineer"],
    "Security": ["IT security", "cybersecurity"],
}

# Points for a keyword found in the title, else in the description, else in the company; an
# exclusion counts once if it is in any of the three.
TITLE_POINTS = {"primary": 10, "secondary": 3}
DESCRIPTION_POINTS = {"primary": 8, "secondary": 2}
COMPANY_POINTS = {"secondary": 1, "company": 5}
EXCLUSION_POINTS = -3

# Used when no category scores: words of the title, then words of title, description and company.
FALLBACK_TITLE = [
    ("Finance & Banking", ["accountant", "accounting", "finance", "financial"]),
    ("Management", ["manager", "director", "supervisor", "head"]),
    ("Administration", ["assistant", "clerk", "secretary", "admin"]),
]
FALLBACK_ROLES = ["officer", "coordinator"]
FALLBACK_CONTEXT = [
    ("Healthcare", ["health", "medical", "clinic"]),
    ("Finance & Banking", ["finance", "accounting", "bank"]),
    ("NGO & Development", ["project", "program", "development"]),
]
FALLBACK_ROLE_CATEGORY = "Administration"
NO_CATEGORY = "Other"

# --- fixed values: category keywords, first match wins ------------------------------------------

FIRST_MATCH = {
    "Healthcare": ["nurse", "doctor", "medical", "health", "hospital", "clinic", "pharmacy", "pharmacist", "therapist", "healthcare", "dentist", "physician", "clinical", "patient", "treatment", "medical officer", "health officer", "nursing", "midwife", "radiographer", "lab technician"],
    "IT & Technology": ["developer", "programmer", "software", "IT", "system", "network", "database", "web", "technology", "computer", "digital", "cyber", "data", "analyst", "technical", "engineer", "coding", "programming", "javascript", "python", "java", "html", "css"],
    "Education & Training": ["teacher", "instructor", "education", "training", "academic", "school", "university", "lecturer", "professor", "tutor", "educational", "curriculum", "learning", "student", "teaching", "trainer", "facilitator"],
    "Finance & Banking": ["accountant", "finance", "banking", "financial", "audit", "budget", "accounting", "economist", "treasurer", "cashier", "credit", "loan", "investment", "tax", "bookkeeper", "payroll"],
    "Sales & Marketing": ["sales", "marketing", "market", "customer", "client", "business development", "promotion", "advertising", "brand", "retail", "commercial", "revenue", "target", "campaign"],
    "Human Resources": ["human resources", "HR", "recruitment", "talent", "personnel", "employee", "payroll", "benefits", "compensation", "training coordinator", "people", "workforce"],
    "Engineering": ["engineer", "engineering", "mechanical", "electrical", "civil", "construction", "architect", "technical", "maintenance", "repair", "installation", "infrastructure", "project engineer"],
    "Administration": ["administrator", "admin", "secretary", "clerk", "assistant", "receptionist", "office", "administrative", "coordinator", "support", "data entry", "filing"],
    "Management": ["manager", "director", "supervisor", "head", "chief", "executive", "leadership", "team lead", "senior", "management", "operations", "strategic", "planning", "CEO", "COO", "CFO"],
    "Agriculture": ["agriculture", "farming", "farmer", "agricultural", "crop", "livestock", "veterinary", "agronomy", "irrigation", "rural", "extension officer"],
    "Legal": ["lawyer", "legal", "attorney", "law", "court", "judicial", "legal officer", "paralegal", "compliance", "contract", "litigation"],
    "NGO & Development": ["NGO", "development", "community", "social", "humanitarian", "volunteer", "nonprofit", "charity", "aid", "relief", "donor", "grant", "project officer"],
    "Consulting": ["consultant", "consulting", "advisory", "expert", "specialist", "freelance", "contractor", "consultancy", "expertise"],
    "Transportation & Logistics": ["driver", "transport", "logistics", "delivery", "shipping", "warehouse", "supply chain", "distribution", "fleet", "cargo"],
    "Security": ["security", "guard", "protection", "safety", "surveillance", "risk", "emergency"],
}

# --- fixed values: places, in order of preference -----------------------------------------------

PLACES = ["Harare", "Bulawayo", "Mutare", "Gweru", "Masvingo", "Chitungwiza", "Zimbabwe"]
DEFAULT_PLACE = "Zimbabwe"

# --- fixed values: dates ------------------------------------------------------------------------

EXPIRY_PREFIX = r"(?iU)^(expires|expiry|closing|closing date)[:\s-]*"
MONTH_DAY_YEAR = r"[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}"
POSTED_DATE = r"\s+([A-Za-z]+\s+\d{1,2},? \d{4})"
DETAIL_DATE = r"[A-Z][a-z]+ \d{1,2},? \d{4}"
POSTED_VALID_DAYS = 30

# --- fixed values: page numbers -----------------------------------------------------------------

PAGE_IN_PATH = r"/page/(\d+)/"
# how a URL asks for the first page
FIRST_PAGE_PATH = r"/page/1/?$"
FIRST_PAGE_PARAMETER = r"^(paged?=1|start=0)$"
PAGE_PARAMETER = r"page=(\d+)"
PAGE_OR_PAGED = r"pag(?:e|ed)=(\d+)"
PAGE_OF_LAST = r"page[=/](\d+)"
PAGE_LABEL = r"(?U)Page\s+[\d,]+"

# --- fixed values: contact addresses ------------------------------------------------------------

PLAIN_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SPACED_EMAIL = r"\b[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9.-]+\s*\.\s*[A-Z|a-z]{2,}\b"
MASKED_EMAIL = r"[A-Za-z0-9._%+-]+\s*\[at\]\s*[A-Za-z0-9.-]+\s*\[dot\]\s*[A-Z|a-z]{2,}"
PLAIN_EMAIL_STRICT = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
MASKED_EMAIL_STRICT = r"[A-Za-z0-9._%+\-]+\s*\[at\]\s*[A-Za-z0-9.\-]+\s*\[dot\]\s*[A-Za-z]{2,}"
UNWANTED_EMAILS = ["noreply", "no-reply", "donotreply", "info@wordpress", "admin@", "webmaster@", "postmaster@", "abuse@", "support@example", "test@", "demo@", "sample@"]
UNWANTED_SENDERS = ["noreply", "no-reply", "donotreply"]
APPLY_WORDS = ["apply", "application", "send", "submit", "email", "contact", "hr@", "recruitment@", "jobs@", "careers@", "vacancy@"]

# --- fixed values: hint words of links and elements ---------------------------------------------

LINK_HREF_HINTS = ["job_id=", "jobid=", "/careers", "/career", "/vacancy", "/jobs/", "/job/"]
LINK_TEXT_HINTS = ["apply", "vacancy", "position", "career", "job", "job code", "job title"]
ANCESTOR_HINTS = ["job", "vacancy", "career", "position", "listing", "result", "search", "post"]
CANDIDATE_HREF_HINTS = ["/job/", "/jobs/", "vacancy"]
JOB_TEXT_WORDS = ["job", "position", "vacancy", "career", "hiring", "apply", "work"]
PAGE_WORDS = ["page", "next", "previous", "«", "»"]
# tag, attribute that must be there, attribute patterns
GENERIC_ELEMENTS = [
    ("div", None, {"class": "(?i)job|listing|card|item"}),
    ("article", None, None),
    ("li", None, None),
    ("div", "data-job", None),
    ("div", None, {"id": "(?i)job"}),
    ("a", None, {"href": "(?i)job|vacancy"}),
]
COMPANY_CLASS = r"(?i)(company|employer|org|org-name)"
NAME_METAS = [("property", "og:site_name"), ("name", "author")]
CONTENT_CLASS = r"(?i)(entry-content|post-content|job-description|vacancy-description)"
CONTENT_ID = r"(?i)(content|main)"
COMPANY_LABELS = ["Company", "Employer", "Organisation", "Organization"]
LOCATION_LABELS = ["Location"]

# --- fixed values: sites ------------------------------------------------------------------------
# profile: site, base URL, id prefix, defaults for missing location, company and contact

SITES = {
    "cards": dict(site="VacancyMail", base_url="https://vacancymail.co.zw/jobs/?ordering=later", id_prefix="VM", location="N/A", company="N/A", contact="N/A"),
    "headings": dict(site="Jobs Zimbabwe", base_url="https://jobszimbabwe.co.zw/", id_prefix="JZ", location="Zimbabwe", company="N/A", contact="Apply on Jobs Zimbabwe"),
    "jsonld": dict(site="ZimboJobs", base_url="https://zimbojobs.com/", id_prefix="ZJ", location="Zimbabwe", company="ZimboJobs Employer", contact="Apply on ZimboJobs"),
    "candidates": dict(site="VacancyBox", base_url="https://vacancybox.co.zw/", id_prefix="VB", location="Zimbabwe", company="VacancyBox Employer", contact="Apply on VacancyBox"),
    "link_detail": dict(site="RecruitmentMatters", base_url="https://www.recruitmentmattersafrica.com/careers/", id_prefix="RM", location="N/A", company="N/A", contact="Apply on RecruitmentMatters"),
    "cards_alt": dict(site="Jobs Zimbabwe", base_url="https://jobszimbabwe.co.zw/", id_prefix="ID", location="Zimbabwe", company="N/A", contact="Apply on Jobs Zimbabwe"),
    "cards_alt_second": dict(site="Jobs Zimbabwe", base_url="https://zimbojobs.com/jobs", id_prefix="ID", location="Zimbabwe", company="N/A", contact="Apply on ZimboJobs"),
}
# selectors of elements that may be listings, in the order in which they are tried
CANDIDATE_SELECTORS = ["article", "div.job-listing", "div.job", "li.job", "div.listing-item", "div.job-item", "ul.jobs li", "div.row.job", "div.post", "div[itemtype*='JobPosting']"]
# limits that a site may set; none holds unless it is asked for
LIMITS = {
    "cards": dict(last_page=29),
    "headings": dict(pages=20, last_page=29),
    "jsonld": dict(generic=10, description=500, pages=20, last_page=29),
    "candidates": dict(candidates=50, looked_up=5, links=20, title=80, description=400, pages=100, near_words=100, last_page=29),
    "link_detail": dict(harvested=200, company=80, location=60, description=500, pages=100, last_page=29),
    "cards_lenient": dict(last_page=49),
    "cards_alt": dict(pages=15, last_page=49),
    "cards_alt_second": dict(pages=15, last_page=49),
}

# Texts that stand in for missing values
MISSING = "N/A"
HEADINGS_DESCRIPTION = "Job posted on Jobs Zimbabwe. Full details available on website."
JSONLD_TITLE = "Job Opportunity"
JSONLD_DESCRIPTION = "See full description on ZimboJobs"
LINK_TITLE = "Job Opportunity"
LINK_DESCRIPTION = "Full details on VacancyBox"
DETAIL_TITLE = "Job Opportunity"
DETAIL_DESCRIPTION = "See full details on site"
JSONLD_LINK_TEXT = "Job Posting"
ALT_DESCRIPTION = "See full description on Indeed"
PLACEHOLDER = dict(
    title="Jobs Available - Visit ZimboJobs.com",
    company="Various Employers",
    location="Zimbabwe",
    description="Job listings may be loaded dynamically. Visit zimbojobs.com directly to view current opportunities.",
    category="General",
)

# --- fixed values: layout of the outputs --------------------------------------------------------

CSV_NAMES = {
    "title": "Job Title",
    "company": "Company",
    "location": "Location",
    "category": "Category",
    "expiry_text": "Expiry Date",
    "description": "Description",
    "source_site": "Source Site",
    "apply_email": "Apply Email",
}
JSON_NAMES = {
    "id": "id",
    "title": "title",
    "company": "company",
    "description": "description",
    "category": "category",
    "source_site": "sourceSite",
    "apply_email": "applyEmail",
    "expiry_text": "closingDate",
}
