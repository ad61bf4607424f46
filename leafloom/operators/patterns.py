"""Fixed values of the evidence rules: patterns and word lists. Results depend on them being as they are."""

MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = rf"\b({MONTH}\s+\d{{1,2}},?\s+\d{{4}}|{MONTH}\s+\d{{4}}|(?:19|20)\d{{2}}(?:\s*[-/]\s*(?:19|20)?\d{{2}})?)\b"
NUMBER = r"(?i)((?:[$][ ]?)?\d(?:[\d,]*\d)?(?:\.\d+)?(?:[ ]?(?:%|percent|percentage points|million|billion|thousand))?)"
MONEY = r"(?i)(\$\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|thousand|m|b))?|\b\d[\d,]*(?:\.\d+)?\s+(?:million|billion|thousand)\s+dollars\b)"
LEGAL = r"(?i)(\b(?:HB|SB|HR|H\.R\.|S\.)\s*\d+[A-Z]?\b|\b\d+\s*U\.?S\.?C\.?\s*(?:§|Sec\.?)?\s*[\w().-]+(?=[\s,.;)]|$)|§+\s*[\w().-]+|\b\d{2,4}\s*(?:\([a-zA-Z0-9]+\)){1,4}\b)"
WORD_STAT = r"(?i)\b((?:(?:about|approximately|around|roughly|nearly|almost|over|under|less than|more than)\s+)?(?:one[- ]third|two[- ]thirds|one[- ]quarter|one[- ]fourth|three[- ]quarters|one[- ]half|half))\b"
WORD_STAT_CONTEXT = r"(?i)\b(share|portion|proportion|percent|percentage|rate|roles?|openings?|workforce|people|students|households|families|funders?|volunteers?|waitlist|giving|portfolio|respondents?|participants?|employees?|companies|requests?|births?|governments?)\b"
WORD_STAT_IDIOM = r"(?i)\b(first half|second half|half day|half-day|half hour|half-hour|half time|half-time)\b"
FUNDING_CONTEXT = r"(?i)\b(fund|funded|funding|grant|grants|investment|invested|investor|loan|loans|donor|donors|capital|award|awarded|committed|raised|financing|philanthrop)\w*\b"
FUNDING_NEGATIVE = r"(?i)\b(fee waiver|fees? exceed|processing additional records|fee category)\b"
FUNDING_ACTION = r"(?i)\b(received|provided|awarded|pledged|committed|granted|funded|invested|loaned|made by|launched|announced|expand its commitment)\b"
FUNDING_SUMMARY = r"(?i)\b(total|known funding|average grant size|average amount of annual foundation funding|capital backlog|economic impact|funding went to|funding to projects|funding channelled|level of funding|created over|generated over|invested nearly|foundation funding was invested|grant funding awarded|grant success rate|median amount|annual expenses|annual grantmaking|top-funded|outliers)\b"
FUNDING_ADVICE = r"(?i)\b(should|recommend|raise the guarantee cap|annually|increased investment of|increase investment of)\b"
REPORT_METADATA = r"(?i)\b(support for (?:this|the) report was provided by|(?:this|the) report (?:has been |was )?made possible by|(?:this|the) (?:report|project|work) (?:has been |was )?supported by|work on (?:this|the) project (?:has been |was )?supported by|core operating support .*? is provided by|generous pro bono support|generous data sharing|contributors include|graphics and layout by|writer:)(?:\b|$| )"
IMPACT = r"(?i)\b(created|generated|helped|served|reached|touched|built|produced|preserved|provided|invested|awarded|funded|reduced|increased|improved|needed|needs|need|backlog|impact)\b"
IMPACT_NEED = r"(?i)\b(backlog|need|needs|impact)\b"
MAGNITUDE = r"(?i)\b(millions?|billions?|thousands?)\b"
PURPOSE = r"(?i)\b(the need to|urgent|urgency|why\b.+\bmatters|problem\b.+\bsolve|exists to|mission is to|purpose is to)\b"
ADVICE = r"(?i)\b(should|recommend|must)\b"
RESOURCE_HINT = r"(?i)\b(programs?|resources?|guides?|toolkits?|surveys?|reports?|databases?|datasets?|index|indices|initiative|initiatives|project|projects|fund|funds|grant|grants|academy|challenge)\b"
RESOURCE_ONLY = r"(?i)\b(survey|report|guide|toolkit|database|dataset|index|indices)\b"
RESOURCE_PHRASE = r"\b((?:[A-Z][A-Za-z0-9&.'’-]+|[A-Z]{2,})(?:\s+(?:[A-Z][A-Za-z0-9&.'’-]+|of|and|for|the|to|[A-Z]{2,})){0,8}\s+(?:Programs?|Resources?|Guides?|Toolkits?|Surveys?|Reports?|Databases?|Datasets?|Index|Initiative|Initiatives|Project|Projects|Fund|Funds|Grant|Grants|Academy|Challenge))\b"
RESOURCE_KINDS = ["survey", "report", "guide", "toolkit", "database", "dataset", "program", "fund", "grant", "initiative", "project", "academy", "challenge"]
RESOURCE_PEOPLE = r"\b(director|chief executive|president|founder|author|authors?)\b"
RESOURCE_LEADS = r"^(this |these |that |about |co-director|senior director|director )"
CALLOUT_LABELS = ["in their own words", "digging deeper", "policy in action", "case study", "stories of impact", "spotlight", "learn more"]
CALLOUT_CUES = r"\b(words|deeper|spotlight|action|impact)\b"
QUOTE = r"""["'“‘]([^"'”’]{24,500})["'”’]"""
LABEL_VALUE = r"^\s*([^:]{2,80}):\s*(.+?)\s*$"
DEFINITION = r"""(?i)\b([A-Za-z][A-Za-z0-9 /"'“”‘’-]{2,80}?)\s*(?:,?\s+which means|means|refers to|is defined as|known as)\s+([^.]{3,240})"""
WHICH_MEANS = r"""(?i)["'“‘]?([A-Za-z][A-Za-z -]{2,60}),?["'”’]?\s+which means\s+([^,.;]{2,120})"""
DEFINITION_SKIPS = r"(?i)^(that |to both |we |they |from )"
TERM_PREFIX = r"(?i)^(?:indicator|term|definition)\s*:\s*"
TERM_QUALIFIER = r"(?i)\s+(?:typically|generally|usually|often)$"
TERM_PRONOUNS = ["it", "this", "that", "these", "those", "which", "who", "what", "there"]
TERM_GENERIC = ["approach", "concept", "method", "process", "statistical technique", "technique"]
TERM_VERBS = r"\b(is|are|was|were|does|do|did|has|have|had|not|in|as|by|to)\b"
TERM_VERBS_CASED = r"\b(is|are|was|were|does|do|did|has|have|had|represent|represents)\b"
QUESTION_PROMPT = r"(?i)^(what|who|when|where|why|how|which)\b.{8,140}$"
RECOMMENDATION = r"(?i)\b(should|must|need to|needs to|recommend|increase|fund|create|adopt|require|expand|establish|invest|coordinate|evaluate)\b"
KEY_FINDING = r"(?i)\b(key finding|finding|we find|this shows|this demonstrates|evidence suggests)\b"
ACTION_START = r"(?i)^\s*(partner|connect|collaborate|hold|develop|enlist|increase|fund|create|adopt|require|expand|establish|invest|coordinate|evaluate|seek|seeking|challenge|challenging|negotiate|negotiating|identify|make sure)\b"
ROLE_HINT = r"(?i)\b(ceo|director|officer|president|founder|manager|chair|principal|partner|professor|secretary|minister|attorney|counsel|lead|head|vp|vice president)\b"
ENTITY_PHRASE = r"\b((?:[A-Z][A-Za-z&.'’-]+|[A-Z]{2,})(?:\s+(?:[A-Z][A-Za-z&.'’-]+|of|and|for|the|[A-Z]{2,})){1,7})\b"
ENTITY_SUFFIXES = ["Act", "Agency", "Association", "Center", "Clinic", "Coalition", "College", "Commission", "Committee", "Community", "Company", "Council", "Department", "Foundation", "Fund", "Health", "Hospital", "Initiative", "Institute", "Network", "Partners", "Project", "School", "University"]
ENTITY_STOPS = ["Annual Report", "Board Members", "Case Study", "Executive Summary", "Financials", "Key Strategies", "Learn More", "Our Donors", "Table"]
ENTITY_ORGANIZATION = r"health|clinic|hospital|medical|authority|authorities|corporation|foundation|fund|partners|network|coalition|council|center"
ENTITY_LAW = r"act|law|regulation"
ENTITY_PROGRAM = r"project|program|initiative"
STATES = ["Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming", "United States"]
URL_LIKE = r"(?i)\b(?:https?://|www\.|[A-Za-z0-9.-]+\.(?:org|com|edu|gov|net)(?:/|\b))"
QUESTION_LEADS = r"^(ask yourself|before you start|consider whether)"
QUESTION_PHRASES = r"\b(ask yourself|questions to ask|guiding questions|discussion questions)\b"
EXAMPLE_LEADS = r"^(for example|example:|sample |hypothetical)"
EXAMPLE_PHRASES = r"\b(example metric|for instance|e\.g\.|hypothetical|scenario|suppose|imagine)\b"
DEFINITIONAL = r"\b(is defined as|are defined as|defined as|definition:|refers to|means)\b"
THRESHOLDS = r"\b(rule|threshold|limit|minimum|maximum|requirement|requires|required|must be|no more than|at least)\b"
SURVEY_SUBJECTS = r"\b(survey respondents?|respondents? to (?:the|our) survey|survey sample|sample size|n=|demographic makeup)\b"
SURVEY_METHODS = r"\b(asked .* questions|closed- and open-ended questions|open-ended questions|responded to (?:the|our) survey)\b"
PUBLICATIONS = r"\b(book|publication|article|chapter|report|guide|toolkit|housing 101|opportunity 360)\b"
PUBLICATION_VERBS = r"\b(created|generated|served|reached|increased|decreased|funded|awarded|received|pledged|provided)\b"
CHART_LEADS = r"^(figure |fig\. |chart |table |base:)"
METHODOLOGY = r"\b(n=\d|sample size|respondents in the survey|demographic makeup|methodolog(?:y|ies))\b"
DEFINITION_LIKE_IMPACT = r"(?i)\b(impact refers to|impact is|is defined as|means)\b"
CITATION_WORDS = r"\b(et al\.|accessed|retrieved|doi|https?://|journal|quarterly|press|vol\.|no\.)\b"
CITATION_VOLUME = r"\b\d+\(\d+\),\s*\d+[-–]\d+\b"
CITATION_PAGE = r"\bp\.\s*\d+\b"
UNITS = r"(?i)^\s*(people|persons|students|households|jobs|acres|tons|dollars|pages|documents|records|months|years|percent|percentage points)\b"
STRONG_METRIC = r"(?i)[$%]|\b(million|billion|thousand|percent)\b"
EXAMPLE_TEXTS = r"^(example|sample)"
LETTER_PHRASES = r"\b(this is a request under|please provide|requester certifies|may i|dear\b)"
QUESTION_SKIP_LEADS = r"^(a bigger,|a narrow,|shouldn’t we|shouldn't we|will your request have an advocacy or media impact)"
QUESTION_SKIP_TEXTS = r"^(figure |fig\. |chart |table )|ask yourself|think ahead of time|what you plan to do"
PURPOSE_PROBLEM = r"(?i)\b(?:need to|urgent(?:ly)?(?: need)? to|problem(?: is| of)?|solve)\s+(.+?)(?:[.;]|$)"
PURPOSE_STAKES = r"(?i)\b(?:because|so that|in order to)\s+(.+?)(?:[.;]|$)"
BENEFICIARIES = r"(?i)\b(?:for|to|among|serving|served|reached|touched|helped)\s+(.+?)(?:[.;,]|$)"
FUNDING_PURPOSE = r"(?i)\b(?:to|for|supporting|toward)\s+(.+?)(?:[.;]|$)"
RECIPIENT = r"(?i)\b(?:to|for|in|into|supporting)\s+(.+?)(?:[.;,]|$)"

#: What a text must have for any candidate: a digit, a mark, or a part of a word of the patterns above, whatever stands around it. Linear to match (RE2's syntax too).
LOOK_WORDS = ["support", "made possible by", "data sharing", "contributors include", "graphics and layout", "writer:", "the need to", "urgen", "matters", "solve", "exists to", "mission is to", "purpose is to"] + ["created", "generated", "helped", "served", "reached", "touched", "built", "produced", "preserved", "provided", "invested", "awarded", "funded", "reduced", "increased", "improved", "need", "backlog", "impact"] + ["program", "resource", "guide", "toolkit", "survey", "report", "database", "dataset", "index", "indices", "initiative", "project", "fund", "grant", "academy", "challenge"] + ["third", "quarter", "fourth", "half", "means", "refers to", "is defined as", "known as", "finding", "we find", "this shows", "this demonstrates", "evidence suggests"]
LOOK = rf"""[0-9?§"“]|(?i:{"|".join(LOOK_WORDS)})|{"|".join(STATES + ENTITY_SUFFIXES)}|^[\s\x0b:]*(?i:what|who|when|where|why|how|which)"""

# --- notes and contents lists (fixed values: results depend on them)

#: A line that begins with a note's number, and with its letter.
NOTE_START = r"^([0-9]{1,3})(?:[.)]\s*(?![0-9])|\s+)(?=\S)"
LETTER_NOTE_START = r"^([a-z])(?:[.)]\s*|\s+)(?=\S)"
#: What a citation has: an address or a year.
CITATION = r"(https?://|www\.|\b(?:19|20)[0-9]{2}\b)"
NOTES_HEADING = r"(?i)^(?:(?:end\s*)?notes?|references|sources)$"

#: Contents lists: their titles, a page number behind a title, before it, alone; leaders; numbered sections; chapters.
CONTENTS_TITLES = ("contents", "table of contents")
PAGE_TAIL = r"(?i)(?:[\s.·•…\-—_]*\b([0-9]{1,4})|[.·•…]{2,}\s*\b([ivxlcdm]{1,7}))\s*$"
PAGE_LEAD = r"^\s*(0?[0-9]{1,3})\s+(\p{Lu}.*)$"
PAGE_ALONE = r"^0?[0-9]{1,3}$"
LEADERS = r"(?:\s*[.·•…]){2,}\s*$"
DASHES = r"^[\s.·•…\-–—_]+"
SECTION_NUMBER = r"^((?:[0-9]+\.)*[0-9]+)\.?\s+"
CHAPTER = r"(?i)^(chapter|part|section|appendix)\s+[0-9ivxlc]+\b[:.]?\s*"
GLOSSARY = r"(?i)\b(key terms|glossary|definitions)\b"
#: What a chart's label is not: a caption's beginning, a note's.
CAPTION_START = r"(?i)^(?:(?:figure|fig\.|table|chart|exhibit|box)\b|(?:source|note)s?\s*[:.])"
#: A value named in a style, with what stands in for it.
NAMED_VALUE = r"var\(\s*(--[\w-]+)\s*(?:,\s*([^()]*(?:\([^()]*\)[^()]*)*))?\)"
TOKEN_NAME = r"\{(\w+)\}"
