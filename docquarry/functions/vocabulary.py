r"""Fixed values that the understanding of questions depends on: acts, topics, intents and entities.

Results must follow these lists and patterns as they stand, their order included. Patterns are read by Java here and by RE2 in
the SQL that queries are held against.
"""

# Acts by key, in order of the registry: name, unit, domain, aliases.
ACTS: dict[str, tuple[str, str, str, list[str]]] = {
    "ipc": ("Indian Penal Code, 1860", "section", "Criminal Law", ["ipc", "indian penal code", "penal code"]),
    "bns": ("Bharatiya Nyaya Sanhita, 2023", "section", "Criminal Law", ["bns", "bharatiya nyaya sanhita", "nyaya sanhita"]),
    "mv": ("Motor Vehicles Act, 1988", "section", "Motor Vehicles & Transport", ["mv act", "motor vehicles act", "motor vehicle act", "mva", "mv", "motor act"]),
    "constitution": ("Constitution of India, 1950", "article", "Constitutional Law", ["constitution", "constitution of india", "coi", "indian constitution"]),
    "crpc": ("Code of Criminal Procedure, 1973", "section", "Criminal Procedure", ["crpc", "code of criminal procedure", "criminal procedure code"]),
    "bnss": ("Bharatiya Nagarik Suraksha Sanhita, 2023", "section", "Criminal Procedure", ["bnss", "bharatiya nagarik suraksha sanhita", "nagarik suraksha sanhita"]),
    "evidence": ("Indian Evidence Act, 1872", "section", "Evidence Law", ["evidence act", "indian evidence act", "iea", "bharatiya sakshya adhiniyam", "bsa", "sakshya"]),
    "consumer": ("Consumer Protection Act, 2019", "section", "Consumer Protection", ["consumer protection act", "consumer act", "cpa", "consumer law"]),
    "it": ("Information Technology Act, 2000", "section", "Cyber & Information Technology", ["it act", "information technology act", "ita", "cyber law"]),
    "contract": ("Indian Contract Act, 1872", "section", "Contract & Commercial Law", ["contract act", "indian contract act", "ica", "contract law", "law of contracts"]),
    "ni": ("Negotiable Instruments Act, 1881", "section", "Banking & Negotiable Instruments", ["ni act", "negotiable instruments act", "negotiable act", "nia", "cheque act"]),
    "cpc": ("Code of Civil Procedure, 1908", "section", "Civil Procedure", ["cpc", "code of civil procedure", "civil procedure code"]),
    "arbitration": ("Arbitration and Conciliation Act, 1996", "section", "Arbitration & ADR", ["arbitration act", "arbitration and conciliation act", "arbitration law"]),
    "rti": ("Right to Information Act, 2005", "section", "Information & Transparency", ["rti", "rti act", "right to information", "right to information act"]),
    "companies": ("Companies Act, 2013", "section", "Corporate Law", ["companies act", "company law", "company act"]),
    "tpa": ("Transfer of Property Act, 1882", "section", "Property & Real Estate", ["tpa", "transfer of property act", "property act", "transfer of property"]),
    "sra": ("Specific Relief Act, 1963", "section", "Civil Remedies", ["specific relief act", "sra", "specific performance act"]),
    "copyright": ("Copyright Act, 1957", "section", "Intellectual Property", ["copyright act", "copyright law", "indian copyright act"]),
    "trademarks": ("Trade Marks Act, 1999", "section", "Intellectual Property", ["trade marks act", "trademark act", "trademarks act", "tma"]),
    "patents": ("Patents Act, 1970", "section", "Intellectual Property", ["patents act", "patent act", "indian patents act"]),
    "pwdva": ("Protection of Women from Domestic Violence Act, 2005", "section", "Family & Domestic Violence", ["pwdva", "domestic violence act", "protection of women from domestic violence act"]),
}

# Topics in order: terms and acts.
TOPICS: dict[str, tuple[list[str], list[str]]] = {
    "murder": (["murder", "homicide", "killing"], ["ipc", "bns"]),
    "cheating": (["cheating", "fraud", "deception", "online cheating"], ["ipc", "bns", "it"]),
    "rape": (["rape", "sexual offence", "sexual assault"], ["ipc", "bns"]),
    "theft": (["theft", "stealing"], ["ipc", "bns"]),
    "defamation": (["defamation", "reputation"], ["ipc", "bns"]),
    "sedition": (["sedition", "sovereignty", "disaffection"], ["ipc", "bns", "constitution"]),
    "bail": (["anticipatory bail", "pre-arrest bail", "bail"], ["crpc", "bnss"]),
    "arrest": (["arrest", "arrest without warrant", "police powers"], ["crpc", "bnss"]),
    "fir": (["fir", "first information report", "zero fir"], ["crpc", "bnss"]),
    "quashing": (["quashing", "inherent powers", "abuse of process"], ["crpc", "bnss"]),
    "privacy": (["privacy", "right to life", "dignity"], ["constitution"]),
    "free speech": (["freedom of speech", "expression", "reasonable restrictions"], ["constitution"]),
    "equality": (["equality", "equal protection"], ["constitution"]),
    "writ": (["writ", "habeas corpus", "mandamus", "certiorari"], ["constitution"]),
    "hacking": (["hacking", "unauthorised access", "cyber crime"], ["it"]),
    "identity theft": (["identity theft", "phishing", "personation"], ["it"]),
    "intermediary": (["intermediary liability", "safe harbour", "due diligence"], ["it"]),
    "obscenity": (["obscene material", "online obscenity"], ["it"]),
    "accident": (["accident compensation", "motor accident", "claims tribunal"], ["mv"]),
    "drunk driving": (["drunk driving", "drink driving", "drink and drive", "drinking and driving", "under influence", "dui"], ["mv"]),
    "helmet": (["helmet", "protective headgear"], ["mv"]),
    "licence": (["driving licence", "licence"], ["mv"]),
    "consumer": (["consumer", "deficiency in service", "unfair trade practice"], ["consumer"]),
    "product liability": (["product liability", "defective product"], ["consumer"]),
    "electronic evidence": (["electronic evidence", "65b certificate", "digital evidence", "admissibility", "screenshot", "whatsapp", "email", "cctv", "recording", "photograph"], ["evidence"]),
    "evidence": (["evidence", "admissibility", "electronic evidence", "digital evidence", "expert opinion", "burden of proof"], ["evidence"]),
    "confession": (["confession", "confession to police"], ["evidence", "crpc", "bnss"]),
    "burden of proof": (["burden of proof", "onus"], ["evidence"]),
    "dowry": (["dowry", "dowry death", "cruelty"], ["ipc", "bns"]),
    "cybercrime": (["hacking", "unauthorised access", "cyber crime", "identity theft", "online cheating", "obscene material", "intermediary liability", "phishing"], ["it"]),
    "fraud": (["cheating", "fraud", "deception", "online cheating"], ["ipc", "bns", "it"]),
    "property": (["right to property", "deprivation of property", "theft"], ["constitution", "ipc"]),
    "contract": (["contract", "agreement", "breach of contract", "specific performance", "consideration"], ["contract"]),
    "breach of contract": (["breach of contract", "specific performance", "damages", "specific relief"], ["contract", "sra"]),
    "negotiable instrument": (["cheque", "promissory note", "bill of exchange", "cheque bounce", "dishonour of cheque", "section 138"], ["ni"]),
    "cheque bounce": (["cheque bounce", "section 138", "dishonour of cheque", "negotiable instrument"], ["ni"]),
    "arbitration": (["arbitration", "arbitral award", "arbitration agreement", "arbitrator", "section 34", "section 11"], ["arbitration"]),
    "civil suit": (["civil suit", "civil procedure", "plaint", "written statement", "decree"], ["cpc"]),
    "rti": (["right to information", "rti application", "rti", "pio", "information commission"], ["rti"]),
    "company law": (["company law", "director", "board of directors", "shareholder", "incorporation"], ["companies"]),
    "transfer of property": (["transfer of property", "sale deed", "lease", "tenant", "landlord", "lis pendens", "part performance"], ["tpa"]),
    "tenancy": (["tenancy", "lease", "rent", "landlord", "eviction"], ["tpa"]),
    "specific performance": (["specific performance", "specific relief", "injunction", "mandatory injunction"], ["sra", "contract"]),
    "injunction": (["injunction", "temporary injunction", "permanent injunction", "stay order", "restraining order"], ["sra", "cpc"]),
    "copyright": (["copyright", "infringement", "fair use", "fair dealing", "moral rights"], ["copyright"]),
    "trademark": (["trademark", "trade mark", "infringement", "passing off"], ["trademarks"]),
    "patent": (["patent", "patent infringement", "compulsory licence", "patentability"], ["patents"]),
    "intellectual property": (["intellectual property", "ip", "copyright", "trademark", "patent"], ["copyright", "trademarks", "patents"]),
    "domestic violence": (["domestic violence", "shared household", "protection order", "residence order"], ["pwdva", "ipc", "bns"]),
    "vehicle registration": (["vehicle registration", "registration", "rc", "registration mark"], ["mv"]),
    "driving licence": (["driving licence", "learner licence", "dl", "learner's licence"], ["mv"]),
    "insurance": (["insurance", "third party insurance", "motor insurance", "no insurance"], ["mv"]),
    "overloading": (["overloading", "excess load", "weight limit", "axle weight"], ["mv"]),
    "traffic offence": (["traffic offence", "traffic rules", "speeding", "dangerous driving"], ["mv"]),
    "writ petition": (["writ petition", "writ", "habeas corpus", "mandamus", "certiorari", "article 226", "article 32"], ["constitution"]),
}

# Intents in order of precedence: patterns and weights, without regard to case.
INTENTS: dict[str, list[tuple[str, float]]] = {
    "citation_lookup": [
        (r"\bair\s+\d{4}\s+\w+\s+\d+", 0.95),
        (r"\bair\s+\d{4}\b", 0.80),
        (r"\(\d{4}\)\s+\d+\s+scc\b", 0.95),
        (r"\d{4}\s+scc\s+online\b", 0.95),
        (r"\d{4}\s+scr\b", 0.80),
        (r"\d{4}\s+cri\s*lj\b", 0.80),
        (r"\d{4}\s+mlj\b", 0.75),
        (r"\d{4}\s+blr\b", 0.75),
        (r"\b(find|fetch|get|show)\b.{0,30}\bcitation\b", 0.70),
        (r"\bfull\s+text\b.{0,30}\b(judgment|judgement)\b", 0.65),
    ],
    "bare_act_query": [
        (r"\bsection\s+\d+[a-z]?\b", 0.85),
        (r"\bs\s*\.\s*\d+[a-z]?\b", 0.75),
        (r"\barticle\s+\d+[a-z]?\b", 0.85),
        (r"\bart\s*\.\s*\d+[a-z]?\b", 0.75),
        (r"\b\w[\w\s]{2,35}act\s*,?\s*\d{4}\b", 0.80),
        (r"\b(ipc|crpc|cpc|ibc|fema|pmla|rera|ndps|pocso|posh|rti\s*act|tpa|ni\s*act|it\s*act|companies\s+act|gst\s*act|arbitration\s+act)\b", 0.75),
        (r"\bschedule\s+[ivxIVX]{1,5}\b", 0.70),
        (r"\b(clause|sub-?section|proviso)\s+\(?\w\)?", 0.65),
    ],
    "legal_overview": [
        (r"\btell\s+me\s+(more\s+)?about\b", 0.83),
        (r"\b(overview|introduction|summary|brief)\s+(of|to|on|about)\b", 0.86),
        (r"\bwhat\s+does\b.{0,40}\b(cover|deal\s+with|regulate|govern|contain|provide|address|include)\b", 0.86),
        (r"\bwhat\s+is\s+(the\s+)?[\w\s]{0,40}\b(act|code|constitution|sanhita|adhiniyam)\b", 0.84),
        (r"\bexplain\s+(the\s+)?[\w\s]{0,40}\b(act|code|constitution|sanhita|adhiniyam|law)\b", 0.82),
        (r"\b(purpose|scope|aim|objective|object|ambit)\s+of\s+(the\s+)?[\w\s]{0,40}\b(act|code|constitution|sanhita|adhiniyam)\b", 0.84),
        (r"\b(main|key|important|major)\s+(provisions|sections|features|areas|topics|points)\b", 0.78),
    ],
    "case_lookup": [
        (r"\b[a-z]\w[\w\s]{1,30}\bv\.?\s+[a-z]\w[\w\s]{1,30}", 0.85),
        (r"\blandmark\s+(case|judgment|ruling)\b", 0.80),
        (r"\b(supreme\s+court|high\s+court|\bsc\b|\bhc\b|nclat|nclt).{0,25}\b(held|hold|ruled|rule|decided|decide|observed|say|said)\b", 0.80),
        (r"\b(find|show|get|search|look\s+up)\b.{0,30}\b(case|cases|judgments?|judgements?|ruling[s]?)\b", 0.80),
        (r"\b(judgments?|judgements?|ruling[s]?|verdict|decision)\b.{0,30}\b(on|in|about|regarding)\b", 0.75),
        (r"\bwrit\s+(petition|of\s+(mandamus|certiorari|prohibition|habeas\s+corpus|quo\s+warranto))", 0.70),
        (r"\bprecedent\b", 0.65),
    ],
    "document_summary": [
        (r"\b(summarize|summarise|summary)\b", 0.90),
        (r"\btl[\s;:\-,]?dr\b", 0.90),
        (r"\b(analyze|analyse|review|explain)\s+(this|the|my)\s+(document|contract|agreement|notice|deed|letter|order|nda|judgment|plaint|petition)", 0.85),
        (r"\b(give\s+me|provide)\s+(a|the)\s+(summary|gist|overview|brief)\b", 0.80),
        (r"\b(key|important|critical|main)\s+(clauses|points|provisions|terms|issues|obligations)\b", 0.75),
        (r"\bwhat\s+(does|is)\s+(this|the)\s+(document|contract|agreement|notice|deed)\b", 0.75),
        (r"\bextract\s+(clauses|provisions|terms|obligations)\b", 0.75),
        (r"\bhighlight\s+(the\s+)?(key|main|important|critical)\b", 0.70),
    ],
    "legal_research": [
        (r"\bwhat\s+happens\s+if\b", 0.66),
        (r"\bwhat\s+if\s+(some\s?one|i|we|a|an|my|he|she|they|the)\b", 0.64),
        (r"\bcan\s+(the\s+)?police\b", 0.68),
        (r"\bcan\s+(i|we|you|he|she|they|a|an|my|some\s?one)\b", 0.60),
        (r"\b(is|are|was|were)\s+it\s+(legal|illegal|a\s+crime|an\s+offen[cs]e|allowed|valid|mandatory|punishable)\b", 0.66),
        (r"\bis\s+.{0,40}?\b(legal|illegal|valid|admissible|allowed|mandatory|punishable|enforceable|a\s+crime|an\s+offen[cs]e)\b", 0.62),
        (r"\b(punishment|penalty|fine|sentence|jail|imprisonment)\s+for\b", 0.66),
        (r"\blegal\s+consequences?\b", 0.66),
        (r"\bconsequences?\s+(of|for|if)\b", 0.58),
        (r"\b(do\s+i\s+need|is\s+it\s+necessary|is\s+it\s+mandatory|am\s+i\s+(allowed|required|liable|entitled|obligated)|do\s+i\s+have\s+to)\b", 0.62),
        (r"\b(my|our|the)\s+(legal\s+)?(rights|liabilit(y|ies)|obligations|options|remed(y|ies))\b", 0.55),
        (r"\b(police|arrest|warrant|bail|anticipatory|fir|complaint|evidence|witness|helmet|licen[cs]e|accident|divorce|tenant|landlord|contract|breach|notice|harass\w*|dowry|defamation|"
         r"slander|libel|cheat\w*|fraud\w*|forgery|theft|robbery|extortion|custody|maintenance|alimony|compensation|negligence|liabilit(y|ies)|consumer|deficiency|"
         r"cyber\w*|hack\w*|phishing|trespass|nuisance|eviction|patent|copyright|trademark|bankrupt\w*|insolvenc\w*|sue|lawsuit|litigation|sedition|murder|homicide|assault|"
         r"kidnap\w*|rape|molestation|pocso|abuse|bribe\w*|corrupt\w*|money\s*launder\w*|smuggl\w*|narcotic|ndps|land\s*grab\w*|encroach\w*|propert(y|ies)|inheritance|"
         r"succession|will\s+dispute|partition|che(que|ck)\s*(bounce|dishonou?r)|dishonou?r\s+of\s+che(que|ck)|domestic\s+violence|workplace\s+harass\w*|"
         r"wrongful\s+(termination|dismissal|arrest|confinement)|human\s+rights|constitutional|writ|pil|rti|gst|income\s+tax|tax\s+evasion|gratuity|provident\s+fund|"
         r"retrenchment|wages|labour|employment|termination|arbitration|injunction|specific\s+performance|cognizable|non-?bailable|charge\s*sheet|remand|"
         r"acquittal|conviction|appeal|review\s+petition)\b", 0.52),
        (r"\bwhat\s+are\s+(the\s+)?(conditions|grounds|requirements|elements|procedure)\s+for\b", 0.87),
        (r"\b(conditions|grounds|requirements|elements|procedure)\s+for\b", 0.82),
        (r"\bwhat\s+(are|is)\s+(the\s+)?(conditions|grounds|requirements|elements|procedure|process|steps|rights|remedies|liabilities)", 0.65),
        (r"\bhow\s+(does|do|can|to)\s+.{3,60}\b(work|apply|operate|function|enforce)\b", 0.60),
        (r"\b(can|may|could|should)\s+(i|we|one|a\s+\w+|an?\s+\w+)\s+(sue|file|appeal|challenge|claim|approach|invoke|enforce)\b", 0.65),
        (r"\b(doctrine|principle|maxim|rule|concept)\s+(of|that|known)\b", 0.65),
        (r"\bunder\s+(the|indian)\s+(law|act|code)\b", 0.60),
        (r"\b(explain|define|describe|elaborate\s+on|what\s+is)\s+(the\s+)?(meaning|scope|ambit|applicability|purview)\b", 0.65),
        (r"\b(rights|obligations|liability|duties|remedies|reliefs)\b", 0.50),
        (r"\b(explain|define|describe)\b", 0.50),
    ],
    "conversation": [
        (r"^\s*(hi+|hey+|hello|hiya|yo|namaste|greetings)(?:\s+[a-z]+){0,4}[\s,.!'-]*$", 0.96),
        (r"^\s*(thanks|thank\s*you|thanx|thx|ty|appreciate|cheers)(?:\s+[a-z]+){0,4}[\s,.!'-]*$", 0.96),
        (r"^\s*(good\s+(morning|afternoon|evening|night)|gm|gn)(?:\s+[a-z]+){0,4}[\s,.!'-]*$", 0.96),
        (r"^\s*(ok(ay)?|k|cool|great|nice|awesome|got\s*it|bye|goodbye|see\s+you)(?:\s+[a-z]+){0,3}[\s,.!'-]*$", 0.90),
        (r"^\s*(how\s+are\s+you|who\s+are\s+you|what\s+can\s+you\s+do|are\s+you\s+a\s+(bot|ai|robot))[\s,.!?'-]{0,10}$", 0.93),
    ],
}

# Entity rules in order: type, confidence, whether case counts, pattern.
ENTITY_RULES: list[tuple[str, float, bool, str]] = [
    ("LEGAL_CITATION", 0.97, False, r"\bAIR\s+\d{4}\s+(?:SC|Bom|Cal|Mad|All|Del|AP|Raj|Ori|Pat|Ker|MP|Guj|HP|Goa|Sik|Gau|Jhr|Utr)\s+\d+"),
    ("LEGAL_CITATION", 0.97, False, r"\(\d{4}\)\s+\d+\s+SCC\s+\d+"),
    ("LEGAL_CITATION", 0.95, False, r"\d{4}\s+SCC\s+OnLine\s+\w+\s+\d+"),
    ("LEGAL_CITATION", 0.88, False, r"\d{4}\s+SCR\s+\d+"),
    ("LEGAL_CITATION", 0.88, False, r"\d{4}\s+Cri\s*L\.?\s*J\.?\s+\d+"),
    ("LEGAL_CITATION", 0.85, False, r"\d{4}\s+(?:MLJ|BLR|ILR|KLT|ALT|BomCR|CLT)\s+\d+"),
    ("LEGAL_CITATION", 0.72, False, r"\bAIR\s+\d{4}\b"),
    ("COURT", 0.95, False, r"\b(?:Allahabad|Bombay|Calcutta|Madras|Delhi|Gujarat|Rajasthan|Karnataka|Kerala|Punjab\s+and\s+Haryana|Gauhati|Orissa|Patna|Andhra\s+Pradesh|Telangana|Jharkhand|Chhattisgarh|"
                            r"Himachal\s+Pradesh|Madhya\s+Pradesh|Uttarakhand|Manipur|Meghalaya|Tripura|Sikkim)\s+High\s+Court\b"),
    ("COURT", 0.90, False, r"\bHigh\s+Court\s+of\s+(?:Judicature\s+at\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"),
    ("COURT", 0.95, False, r"\bSupreme\s+Court(?:\s+of\s+India)?\b"),
    ("COURT", 0.93, False, r"\bNational\s+Company\s+Law\s+(?:Appellate\s+)?Tribunal\b|\bNational\s+Green\s+Tribunal\b|\bIncome\s+Tax\s+Appellate\s+Tribunal\b|\bDebt\s+Recovery\s+(?:Appellate\s+)?Tribunal\b"),
    ("COURT", 0.92, True, r"\b(?:NCLAT|NCLT|SAT|TDSAT|NGT|ITAT|CESTAT|DRT|DRAT|BIFR)\b"),
    ("COURT", 0.75, False, r"\bHigh\s+Court\b"),
    ("ACT", 0.93, True, r"\b(?:IPC|CrPC|Cr\.P\.C\.|CPC|C\.P\.C\.|IBC)\b"),
    ("ACT", 0.90, False, r"\b(?:FEMA|PMLA|RERA|NDPS|POCSO|POSH|TPA|SEBI\s+Act|RTI\s+Act|NI\s+Act|IT\s+Act|GST\s+Act|MV\s+Act|EPF\s+Act|ESIC\s+Act|SARFAESI)\b"),
    ("ACT", 0.92, False, r"\b(?:Indian\s+Penal\s+Code|Code\s+of\s+Criminal\s+Procedure|Code\s+of\s+Civil\s+Procedure|Insolvency\s+and\s+Bankruptcy\s+Code)\b"),
    ("ACT", 0.90, True, r"\b[A-Z][a-z]{2,}(?:\s+(?:and\s+|of\s+|for\s+|on\s+)?[A-Za-z]{2,}){1,5}\s+Act\s*,\s*\d{4}\b"),
    ("ACT", 0.78, True, r"\b[A-Z][a-z]{2,}(?:\s+(?:and\s+|of\s+|for\s+|on\s+)?[A-Za-z]{2,}){1,5}\s+Act\b"),
    ("SECTION", 0.95, False, r"\bSection\s+\d+[A-Za-z]?\s*\(\w\)"),
    ("SECTION", 0.93, False, r"\bSection\s+\d+[A-Za-z]?\b"),
    ("SECTION", 0.85, False, r"\bSec\.?\s+\d+[A-Za-z]?\b"),
    ("SECTION", 0.94, False, r"\b(?:IPC|CrPC|Cr\.?P\.?C\.?|CPC|BNSS|BNS|NI\s*Act|IT\s*Act|MV\s*Act)\s+\d+[A-Za-z]?\b"),
    ("SECTION", 0.94, False, r"\b\d+[A-Za-z]?\s+(?:IPC|CrPC|Cr\.?P\.?C\.?|CPC|BNSS|BNS|NI\s*Act|IT\s*Act|MV\s*Act)\b"),
    ("ARTICLE", 0.95, False, r"\bArticle\s+\d+[A-Za-z]?\s*\(\w\)"),
    ("ARTICLE", 0.93, False, r"\bArticle\s+\d+[A-Za-z]?\b"),
    ("ARTICLE", 0.85, False, r"\bArt\.?\s+\d+[A-Za-z]?\b"),
]

# Questions that stand by themselves, cues of follow-ups, intents that retrieve, and what a provision can be looked up by.
SELF_CONTAINED = r"(?i)\b(section|sec\.?|article|art\.?|ipc|crpc|cpc|bns|bnss|\bact\b|constitution)\b"
FOLLOWUP_CUE = (r"(?i)^\s*(what|and|its|it|how|when|where|why|is|are|can|does|do|any|give|list|show|more|also|elaborate|continue|explain|tell\s+me|what\s+about|punishment|penalty|exceptions?|"
                r"defen[cs]e|procedure|meaning|example|that|this|the\s+punishment)\b")
RAG_INTENTS = ["legal_research", "document_summary", "legal_overview"]
ANCHOR_TYPES, ANCHOR_LEAST = ["ACT", "SECTION", "ARTICLE", "LEGAL_CITATION"], 0.80
# Courts whose names have one form, whatever their case.
COURTS = {"supreme court": "Supreme Court of India", "supreme court of india": "Supreme Court of India", "high court": "High Court",
          "nclat": "NCLAT", "nclt": "NCLT", "sat": "SAT", "tdsat": "TDSAT", "ngt": "NGT", "itat": "ITAT", "cestat": "CESTAT", "drt": "DRT", "drat": "DRAT", "bifr": "BIFR"}
# What each further matching pattern adds to an intent, how much at most, the most in all, and the least that counts.
BONUS, MOST_BONUS, MOST, LEAST = 0.04, 0.10, 0.99, 0.45
