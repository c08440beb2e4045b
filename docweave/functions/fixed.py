"""Word lists, patterns, formats and tables that results depend on.

They are data, not rules of ours: an equal result needs equal values. Order matters where a first match decides.
"""

# Fixed values throughout this file.

#: Whole phrases that trigger the access and benefit-sharing check.
ABS_PHRASES = [
    "abs",
    "access and benefit sharing",
    "access & benefit sharing",
    "access and benefit-sharing",
    "access & benefit-sharing",
    "national biodiversity authority",
    "nba approval",
    "state biodiversity board",
    "biodiversity board",
    "sbb intimation",
    "biological diversity act",
    "biological diversity amendment",
    "bd act",
    "bda 2002",
    "bda 2023",
    "nagoya protocol",
    "biodiversity management committee",
    "bmc certificate",
    "certificate of origin",
    "form 1",
    "form 2",
    "form 11",
    "form 12",
]

BIO_PATTERNS = [
    r"\bplant\b",
    r"\bplants\b",
    r"\bherb\b",
    r"\bherbs\b",
    r"\bherbal\b",
    r"\bextract\b",
    r"\bextracts\b",
    r"\bleaf\b",
    r"\bleaves\b",
    r"\broot\b",
    r"\broots\b",
    r"\bbark\b",
    r"\bseed\b",
    r"\bseeds\b",
    r"\bflora\b",
    r"\bfauna\b",
    r"\bmarine organism\b",
    r"\bmedicinal plant\b",
    r"\bbiological resource\b",
    r"\bbio-resource\b",
    r"\bbioresourc\w*",
    r"\bneem\b",
    r"\bashwagandha\b",
    r"\bturmeric\b",
    r"\bbrahmi\b",
    r"\btulsi\b",
    r"\bayurvedic ingredient\b",
    r"\bnatural formulation\b",
]

SOURCE_PATTERNS = [
    r"\bsourced\b",
    r"\bsourcing\b",
    r"\bcollected\b",
    r"\bcollecting\b",
    r"\bharvested\b",
    r"\bharvesting\b",
    r"\bobtained from\b",
    r"\bprocured from\b",
    r"\bgrown in\b",
    r"\bnative to\b",
    r"\bfrom kerala\b",
    r"\bfrom india\b",
    r"\bfrom western ghats\b",
    r"\bfrom himalayas\b",
    r"\bwild-harvested\b",
    r"\bcultivated\b",
]

COMMERCIAL_PATTERNS = [
    r"\bexport\b",
    r"\bexporting\b",
    r"\bexported\b",
    r"\bcommercial\b",
    r"\bcommercialize\b",
    r"\bcommercializing\b",
    r"\bcommercialisation\b",
    r"\bcommercial utilization\b",
    r"\bsell\b",
    r"\bselling\b",
    r"\bmanufacture\b",
    r"\bmanufacturing\b",
    r"\bsupplement\b",
    r"\bformulation\b",
    r"\bapproval\b",
    r"\bpermission\b",
    r"\blicense\b",
    r"\blicensing\b",
]

#: (state, board), in the order in which states are looked for.
STATE_BOARDS = [
    ("kerala", "Kerala State Biodiversity Board (KSBB)"),
    ("tamil nadu", "Tamil Nadu State Biodiversity Board (TNSBB)"),
    ("karnataka", "Karnataka Biodiversity Board (KBB)"),
    ("maharashtra", "Maharashtra State Biodiversity Board (MSBB)"),
    ("uttarakhand", "Uttarakhand Biodiversity Board (UBB)"),
    ("himachal pradesh", "Himachal Pradesh State Biodiversity Board (HPSBB)"),
    ("madhya pradesh", "Madhya Pradesh State Biodiversity Board (MPSBB)"),
    ("gujarat", "Gujarat Biodiversity Board (GBB)"),
    ("rajasthan", "Rajasthan State Biodiversity Board (RSBB)"),
    ("andhra pradesh", "Andhra Pradesh State Biodiversity Board (APSBB)"),
    ("telangana", "Telangana State Biodiversity Board (TSBB)"),
    ("odisha", "Odisha Biodiversity Board (OBB)"),
    ("west bengal", "West Bengal Biodiversity Board (WBBB)"),
    ("assam", "Assam State Biodiversity Board (ASBB)"),
    ("bihar", "Bihar State Biodiversity Board (BSBB)"),
    ("punjab", "Punjab Biodiversity Board (PBB)"),
    ("haryana", "Haryana State Biodiversity Board (HSBB)"),
    ("uttar pradesh", "Uttar Pradesh State Biodiversity Board (UPSBB)"),
    ("chhattisgarh", "Chhattisgarh State Biodiversity Board (CSBB)"),
    ("jharkhand", "Jharkhand State Biodiversity Board (JSBB)"),
    ("goa", "Goa State Biodiversity Board (GSBB)"),
    ("jammu and kashmir", "Jammu & Kashmir Biodiversity Council (JKBC)"),
    ("ladakh", "Ladakh Biodiversity Council (LBC)"),
    ("sikkim", "Sikkim State Biodiversity Board (SSBB)"),
    ("arunachal pradesh", "Arunachal Pradesh State Biodiversity Board (APSBB)"),
    ("meghalaya", "Meghalaya State Biodiversity Board (MSBB)"),
    ("manipur", "Manipur State Biodiversity Board (MSBB)"),
    ("mizoram", "Mizoram State Biodiversity Board (MSBB)"),
    ("nagaland", "Nagaland State Biodiversity Board (NSBB)"),
    ("tripura", "Tripura Biodiversity Board (TBB)"),
]

CLASSICAL_PATTERNS = [
    r"classical\s+(?:medicine|formulation|recipe|oil|remedy|ayurvedic|preparation|drug|herb|text)",
    r"\bclassical\b",
    r"traditional\s+(?:knowledge|formulation|medicine|recipe|remedy|ayurvedic|herbal|oil)",
    r"ayurvedic\s+(?:recipe|text|formulation|oil|preparation|medicine|herb)",
    r"grandmother(?:'s)?(?:\s+\w+){0,4}\s+(?:recipe|oil|remedy|cure|formulation)",
    r"ancestral\s+(?:recipe|remedy|oil|formulation)",
    r"ancient\s+(?:text|recipe|manuscript|formulation|ayurvedic)",
    "charaka",
    "sushruta",
    "vagbhata",
    r"ashtanga\s+hridaya",
    "sahasrayogam",
    "bhavaprakasha",
    "sharangadhara",
    r"first\s+schedule",
    r"classical\s+herb",
    r"ayurvedic\s+herb",
    "unani",
    "siddha",
    "sowa-rigpa",
    "dravyaguna",
    r"taila\s+kalpana",
    "churna",
    "asava",
    "arishta",
    "ghrita",
    "bhasma",
    "rasayana",
]

PRIOR_ART_PATTERNS = [
    "patent",
    "patenting",
    "patentable",
    "patentability",
    r"can\s+(?:this|someone|anyone|i)\s+(?:else\s+)?patent",
    r"can\s+be\s+patented",
    r"prior\s*art",
    "prior-art",
    r"already\s+known",
    r"protect\s+(?:it\s+)?from\s+others\s+patenting",
    r"protect\s+from\s+others\s+patenting",
    "novelty",
    "anticipat(?:e|ed|ion)",
    r"public\s+domain",
    r"section\s+3\s*\(\s*p\s*\)",
    r"sec(?:tion)?\s*3\s*p",
    r"3\s*\(\s*p\s*\)",
    "tkdl",
    r"traditional\s+knowledge\s+digital\s+library",
    r"search\s+tkdl",
    r"examiner\s+objection",
    r"first\s+examination\s+report",
    r"fer\s+objection",
]

BOTANICALS = [
    "turmeric",
    "curcuma",
    "haridra",
    "neem",
    "azadirachta",
    "ashwagandha",
    "withania",
    "tulsi",
    "ocimum",
    "ginger",
    "zingiber",
    "garlic",
    "sesame",
    "tila",
    "coconut",
    "amla",
    "emblica",
    "triphala",
    "brahmi",
    "bacopa",
    "guggulu",
    "commiphora",
    "shallaki",
    "boswellia",
    "castor",
    "eranda",
]

STATUTE_VETO_PATTERNS = [
    r"section\s+\d+",
    r"rule\s+\d+",
    r"article\s+\d+",
    r"what does\s+section",
    r"what is\s+section",
    r"what does\s+rule",
    r"what is\s+rule",
    "provisions of",
    r"what does\s+the\s+patents act",
    r"what does\s+the\s+drugs and cosmetics",
    r"what is\s+the\s+nagoya protocol",
    r"what is\s+the\s+trips",
    r"explain\s+section",
    r"explain\s+rule",
    r"explain\s+article",
]

PATENT_VETO_PATTERNS = [
    r"can\s+.*\s+(?:be\s+patented|patent)",
    r"is\s+.*\s+patentable",
    "patentability",
    r"prior\s*art",
    r"not\s+patentable",
    r"excluded\s+from\s+patentability",
    r"protect\s+(?:it\s+)?from\s+others\s+patenting",
]

FORMULATION_PHRASES = [
    "my formulation",
    "our formulation",
    "this formulation",
    "my product",
    "our product",
    "my oil",
    "our oil",
    "my medicine",
    "our medicine",
    "my extract",
    "our extract",
    "my syrup",
    "grandmother",
    "grandfather",
    "family recipe",
    "my recipe",
    "our recipe",
    "traditional recipe",
    "new recipe",
    "want to sell",
    "want to manufacture",
    "want to commercialize",
    "want to patent my",
    "protect my",
    "can i patent my",
    "can i sell my",
    "which category does my",
    "how to classify my",
    "licensing required for my",
    "novel formulation",
    "new formulation",
    "developed a formulation",
    "made a formulation",
    "herbal product of mine",
    "classified as a drug",
    "classified as cosmetic",
    "classified as nutraceutical",
]

FOLLOWUP_PATTERNS = [
    r"(?i)\b(?:what|how)\s+about\b",
    r"(?i)\bwhat\s+if\b",
    r"(?i)\binstead\b",
    r"(?i)\bdoes\s+(?:that|this)\s+also\s+apply\b",
    r"(?i)\band\s+for\b",
    r"(?i)\bcompare\s+(?:that|this|it)\b",
    r"(?i)\bcan\s+(?:it|that|this)\s+be\b",
    r"(?i)\bis\s+(?:it|that|this)\s+(?:also|different)\b",
]

TRANSLATE_ENGLISH = [
    r"(?:convert|translate|give|explain|show|write|rephrase|tell|provide).*(?:above|previous|last|that|it|this|response|answer|message).*(?:in|to|into)\s*(?:english|eng|angrezi)",
    r"(?:in|to|into)\s*(?:english|eng|angrezi)\s*(?:please|plz)?$",
    r"(?:english|angrezi)\s*(?:please|translation|me|mein|version|variant)?$",
    r"translate\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*english",
    r"convert\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*english",
    "अंग्रेजी में",
    "अंग्रेज़ी में",
    "अंग्रेजी अनुवाद",
    "अंग्रेज़ी अनुवाद",
    "उपरोक्त.*अंग्रेजी",
    "उपरोक्त.*अंग्रेज़ी",
]

TRANSLATE_HINDI = [
    r"(?:convert|translate|give|explain|show|write|rephrase|tell|provide).*(?:above|previous|last|that|it|this|response|answer|message).*(?:in|to|into)\s*(?:hindi|हिंदी|हिन्दी)",
    r"(?:in|to|into)\s*(?:hindi|हिंदी|हिन्दी)\s*(?:please|plz)?$",
    r"(?:hindi|हिंदी|हिन्दी)\s*(?:please|translation|me|mein|version|variant)?$",
    r"translate\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*hindi",
    r"convert\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*hindi",
    "हिंदी में",
    "हिन्दी में",
    "हिंदी अनुवाद",
    "हिन्दी अनुवाद",
    "उपरोक्त.*हिंदी",
    "उपरोक्त.*हिन्दी",
]

TRANSLATE_PUNJABI = [
    r"(?:convert|translate|give|explain|show|write|rephrase|tell|provide).*(?:above|previous|last|that|it|this|response|answer|message).*(?:in|to|into)\s*(?:punjabi|panjabi|gurmukhi|ਪੰਜਾਬੀ)",
    r"(?:in|to|into)\s*(?:punjabi|panjabi|gurmukhi|ਪੰਜਾਬੀ)\s*(?:please|plz)?$",
    r"(?:punjabi|panjabi|gurmukhi|ਪੰਜਾਬੀ)\s*(?:please|translation|me|mein|version|variant)?$",
    r"translate\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*(?:punjabi|panjabi)",
    r"convert\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*(?:punjabi|panjabi)",
    "ਪੰਜਾਬੀ ਵਿੱਚ",
    "ਪੰਜਾਬੀ ਅਨੁਵਾਦ",
    "ਉਪਰੋਕਤ.*ਪੰਜਾਬੀ",
]

TRANSLATE_MALAYALAM = [
    r"(?:convert|translate|give|explain|show|write|rephrase|tell|provide).*(?:above|previous|last|that|it|this|response|answer|message).*(?:in|to|into)\s*(?:malayalam|മലയാളം)",
    r"(?:in|to|into)\s*(?:malayalam|മലയാളം)\s*(?:please|plz)?$",
    r"(?:malayalam|മലയാളം)\s*(?:please|translation|me|mein|version|variant)?$",
    r"translate\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*malayalam",
    r"convert\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*malayalam",
    "മലയാളത്തിൽ",
    "മലയാളം വിവർത്തനം",
]

TRANSLATE_TAMIL = [
    r"(?:convert|translate|give|explain|show|write|rephrase|tell|provide).*(?:above|previous|last|that|it|this|response|answer|message).*(?:in|to|into)\s*(?:tamil|தமிழ்)",
    r"(?:in|to|into)\s*(?:tamil|தமிழ்)\s*(?:please|plz)?$",
    r"(?:tamil|தமிழ்)\s*(?:please|translation|me|mein|version|variant)?$",
    r"translate\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*tamil",
    r"convert\s+(?:the\s+)?(?:above|previous|this|that|it)?\s*(?:response|answer)?\s*(?:to|in|into)?\s*tamil",
    "தமிழில்",
    "தமிழ் மொழிபெயர்ப்பு",
]

#: (keyword, file), first match wins.
FILE_KEYWORDS = [
    ("pct", "PCT (Patent Cooperation Treaty).pdf"),
    ("patent", "Patents Act, 1970.pdf"),
    ("gratk", "WIPO GRATK Treaty (2024).pdf"),
    ("nagoya", "Nagoya Protocol.pdf"),
    ("trips", "trips_agreement.pdf"),
    ("cbd", "Convention on Biological Diversity (CBD).pdf"),
    ("magic remedies", "Drugs and Magic Remedies (Objectionable Advertisements) Act.pdf"),
    ("dmr", "Drugs and Magic Remedies (Objectionable Advertisements) Act.pdf"),
    ("aahara", "Gazette_Notification_Ayurveda_Aahara.pdf"),
    ("fssai", "Gazette_Notification_Ayurveda_Aahara.pdf"),
    ("phytopharmaceutical", "Phytopharmaceutical-Drugs-General-Guidance-for-Development.pdf"),
    ("ipc", "Phytopharmaceutical-Drugs-General-Guidance-for-Development.pdf"),
    ("2025", "The Biological Diversity (Amendment) Rules, 2025.pdf"),
    ("bd rules", "The Biological Diversity Rules, 2024.pdf"),
    ("biological diversity", "Biological Diversity (Amendment) Act, 2023.pdf"),
    ("bda", "Biological Diversity (Amendment) Act, 2023.pdf"),
    ("biodiversity", "Biological Diversity (Amendment) Act, 2023.pdf"),
    ("drug", "2016DrugsandCosmeticsAct1940Rules1945.pdf"),
    ("cosmetic", "2016DrugsandCosmeticsAct1940Rules1945.pdf"),
    ("d&c", "2016DrugsandCosmeticsAct1940Rules1945.pdf"),
    ("trademark", "The Trade Marks Act, 1999.pdf"),
    ("trade mark", "The Trade Marks Act, 1999.pdf"),
    ("copyright", "The Copyright Act, 1957.pdf"),
    ("geographical", "Geographical Indications of Goods.pdf"),
    ("gi act", "Geographical Indications of Goods.pdf"),
    ("design", "The Designs Act, 2000 (Act No. 16 of 2000).pdf"),
]

#: (keyword, url), first match wins.
URL_KEYWORDS = [
    ("pct", "https://www.wipo.int/pct/en/texts/"),
    ("patent", "https://www.indiacode.nic.in/handle/123456789/1392"),
    ("gratk", "https://www.wipo.int/gratk/en/"),
    ("nagoya", "https://www.cbd.int/abs/text/"),
    ("trips", "https://www.wto.org/english/docs_e/legal_e/27-trips_01_e.htm"),
    ("cbd", "https://www.cbd.int/convention/text/"),
    ("magic remedies", "https://www.indiacode.nic.in/handle/123456789/1429"),
    ("dmr", "https://www.indiacode.nic.in/handle/123456789/1429"),
    ("biological diversity rules", "http://nbaindia.org/"),
    ("biological diversity", "https://www.indiacode.nic.in/handle/123456789/2056"),
    ("bda", "https://www.indiacode.nic.in/handle/123456789/2056"),
    ("cosmetics", "https://cdsco.gov.in/opencms/opencms/en/Acts-and-rules/"),
    ("drug", "https://cdsco.gov.in/opencms/opencms/en/Acts-and-rules/"),
    ("aahara", "https://www.fssai.gov.in/"),
    ("phytopharmaceutical", "https://ipc.gov.in/"),
    ("trademark", "https://www.indiacode.nic.in/handle/123456789/1993"),
    ("trade mark", "https://www.indiacode.nic.in/handle/123456789/1993"),
    ("copyright", "https://copyright.gov.in/"),
    ("geographical indication", "https://ipindia.gov.in/geographical-indications.htm"),
    ("design", "https://ipindia.gov.in/designs.htm"),
]

LANGUAGE_ALIASES = [
    ("en", "en"),
    ("english", "en"),
    ("eng", "en"),
    ("hi", "hi"),
    ("hindi", "hi"),
    ("hin", "hi"),
    ("pa", "pa"),
    ("punjabi", "pa"),
    ("panjabi", "pa"),
    ("pun", "pa"),
    ("ml", "ml"),
    ("malayalam", "ml"),
    ("mal", "ml"),
    ("ta", "ta"),
    ("tamil", "ta"),
    ("tam", "ta"),
]

#: (code, name, native name, script)
LANGUAGES = [
    ("en", "English", "English", "Latin"),
    ("hi", "Hindi", "हिन्दी", "Devanagari"),
    ("pa", "Punjabi", "ਪੰਜਾਬੀ", "Gurmukhi"),
    ("ml", "Malayalam", "മലയാളം", "Malayalam"),
    ("ta", "Tamil", "தமிழ்", "Tamil"),
]

#: (pattern, text), applied in order.
KEY_SYNONYMS = [
    (r"\bcan i patent\b", "patentability of"),
    (r"\bhow to patent\b", "patentability of"),
    (r"\bis.*patentable\b", "patentability of"),
    (r"\bayurveda\b", "ayurvedic"),
    (r"\bherbs\b", "herbal"),
    (r"\bsection 3 p\b", "section 3(p)"),
    (r"\bsec 3p\b", "section 3(p)"),
    (r"\bsec 3 p\b", "section 3(p)"),
]

CLASS_CITATIONS = [
    ("classical_medicine", "Section 3(a), D&C Act + Rule 154-A(1)(a), D&C Rules"),
    ("proprietary_medicine", "Section 3(h), D&C Act 1940 + Rule 154-A(1)(c), D&C Rules"),
    ("new_drug", "Rule 158-B, D&C Rules"),
    ("phytopharmaceutical", "Gazette Notification G.S.R. 918(E), 30 Nov 2015"),
    ("nutraceutical", "Section 22, Food Safety and Standards Act 2006 + FSSAI (Health Supplements and Nutraceuticals) Regulations 2022"),
    ("cosmetic", "Section 3(aaa), D&C Act 1940 + Cosmetics Rules 2020"),
]

FORMULATION_QUESTIONS = [
    "is_first_schedule_text",
    "requires_new_safety_efficacy",
    "is_standardized_plant_extract",
    "is_food_dietary_product",
    "is_topical_cosmetic",
]

ABS_QUESTIONS = [
    "is_sourced_from_india",
    "is_commercial_use",
    "is_foreign_entity",
]

#: (title, article), in the order in which they are tried.
CBD_TITLES = [
    ("Objectives", "1"),
    ("Use of Terms", "2"),
    ("Principle", "3"),
    ("Jurisdictional Scope", "4"),
    ("Cooperation", "5"),
    ("General Measures for Conservation", "6"),
    ("Identification and Monitoring", "7"),
    ("In-situ Conservation", "8"),
    ("Ex-situ Conservation", "9"),
    ("Sustainable Use of Components", "10"),
    ("Incentive Measures", "11"),
    ("Research and Training", "12"),
    ("Public Education and Awareness", "13"),
    ("Impact Assessment and Minimizing", "14"),
    ("Access to Genetic Resources", "15"),
    ("Access to and Transfer of Technology", "16"),
    ("Exchange of Information", "17"),
    ("Technical and Scientific Cooperation", "18"),
    ("Handling of Biotechnology", "19"),
    ("Financial Resources", "20"),
    ("Financial Mechanism", "21"),
    ("Relationship with Other International", "22"),
    ("Conference of the Parties", "23"),
    ("Secretariat", "24"),
    ("Subsidiary Body", "25"),
    ("Reports", "26"),
    ("Settlement of Disputes", "27"),
    ("Adoption of Protocols", "28"),
    ("Amendment of the Convention", "29"),
    ("Adoption and Amendment of Annexes", "30"),
    ("Right to Vote", "31"),
    ("Relationship between this Convention", "32"),
    ("Signature", "33"),
    ("Ratification, Acceptance", "34"),
    ("Accession", "35"),
    ("Entry into Force", "36"),
    ("Reservations", "37"),
    ("Withdrawals", "38"),
    ("Financial Interim Arrangements", "39"),
    ("Secretariat Interim Arrangements", "40"),
    ("Depositary", "41"),
    ("Authentic Texts", "42"),
]

NAGOYA_TITLES = [
    ("OBJECTIVE", "1"),
    ("USE OF TERMS", "2"),
    ("SCOPE", "3"),
    ("RELATIONSHIP WITH INTERNATIONAL", "4"),
    ("FAIR AND EQUITABLE BENEFIT-SHARING", "5"),
    ("ACCESS TO GENETIC RESOURCES", "6"),
    ("ACCESS TO TRADITIONAL KNOWLEDGE", "7"),
    ("SPECIAL CONSIDERATIONS", "8"),
    ("CONTRIBUTION TO CONSERVATION", "9"),
    ("GLOBAL MULTILATERAL BENEFIT-SHARING", "10"),
    ("TRANSBOUNDARY COOPERATION", "11"),
    ("TRADITIONAL KNOWLEDGE ASSOCIATED", "12"),
    ("NATIONAL FOCAL POINTS", "13"),
    ("THE ACCESS AND BENEFIT-SHARING CLEARING-HOUSE", "14"),
    ("COMPLIANCE WITH DOMESTIC LEGISLATION OR REGULATORY REQUIREMENTS ON ACCESS AND BENEFIT-SHARING FOR TRADITIONAL", "16"),
    ("COMPLIANCE WITH DOMESTIC LEGISLATION", "15"),
    ("MONITORING THE UTILIZATION", "17"),
    ("COMPLIANCE WITH MUTUALLY AGREED TERMS", "18"),
    ("MODEL CONTRACTUAL CLAUSES", "19"),
    ("CODES OF CONDUCT", "20"),
    ("AWARENESS-RAISING", "21"),
    ("CAPACITY", "22"),
    ("TECHNOLOGY TRANSFER", "23"),
    ("NON-PARTIES", "24"),
    ("FINANCIAL MECHANISM", "25"),
    ("CONFERENCE OF THE PARTIES", "26"),
    ("SUBSIDIARY BODIES", "27"),
    ("SECRETARIAT", "28"),
    ("MONITORING AND REPORTING", "29"),
    ("PROCEDURES AND MECHANISMS", "30"),
    ("ASSESSMENT AND REVIEW", "31"),
    ("SIGNATURE", "32"),
    ("ENTRY INTO FORCE", "33"),
    ("RESERVATIONS", "34"),
    ("WITHDRAWAL", "35"),
    ("AUTHENTIC TEXTS", "36"),
]

#: (pattern, text appended where it is found), in order.
EXPANSIONS = [
    (r"(?i)\b(inventive\s+step|technical\s+advance|non[\s-]obvious)\b", "Section 2(1)(ja) inventive step technical advance economic significance not obvious"),
    (r"(?i)\b(patentab(?:ility|le)|patent\s+criteria|qualif(?:y|ies|ied)\s+as\s+(?:an\s+)?(?:new\s+)?invention|definition\s+of\s+invention|what\s+(?:is|qualifies\s+as)\s+(?:an?\s+)?(?:new\s+)?invention)\b", "Section 2(1)(j) Section 2(1)(ja) Section 2(1)(l) invention new product process capable of industrial application not anticipated"),
    (r"(?i)\b(new\s+invention|prior\s+art|anticipated\s+by\s+publication|state\s+of\s+the\s+art|public\s+domain)\b", "Section 2(1)(l) new invention not anticipated publication public domain state of the art"),
    (r"(?i)\b(pharmaceutical\s+substance)\b", "Section 2(1)(ta) pharmaceutical substance new entity inventive steps"),
    (r"(?i)\b(capable\s+of\s+industrial\s+application|industrial\s+applicability)\b", "Section 2(1)(ac) capable of industrial application made or used in industry"),
    (r"(?i)\b(synthetic\s+(?:derivative|modification|substance|compound)|structurally\s+modified|chemically\s+modified|isolated\s+active\s+(?:compound|moiety|fraction|alkaloid|molecule)|plant[\s-]derived\s+(?:chemical|compound|molecule|alkaloid|substance)|derivative\s+of\s+(?:a\s+)?(?:chemical\s+compound|naturally\s+occurring|plant|substance)|novel\s+chemical\s+(?:compound|substance)|modified\s+(?:active\s+)?(?:molecule|moiety|substance|compound))\b", "Section 2(1)(j) Section 2(1)(ja) Section 3(d) Patents Act invention new product process inventive step technical advance enhanced efficacy derivative known substance"),
    (r"(?i)\b(enhanced\s+efficacy|new\s+form\s+of\s+known\s+substance|therapeutic\s+efficacy|differ\s+significantly\s+in\s+properties|derivative\s+of\s+known\s+substance)\b", "Section 3(d) known substance enhanced efficacy therapeutic efficacy not patentable unless significant enhancement derivative"),
    (r"(?i)\b(mere\s+admixture|admixture\s+resulting\s+only\s+in\s+aggregation)\b", "Section 3(e) substance obtained by admixture aggregation of properties not patentable"),
    (r"(?i)\b(traditional\s+(?:knowledge|herbal|medicinal|remedy|medicine|formulation|recipe|practice)|botanical\s+knowledge|classical(?:\s+\w+){0,4}\s+(?:formulation|remedy|medicine|drug|preparation|churna|rasayana|oil|recipe|taila|avaleha|kwatha|ghrita|ayurvedic)|ayurvedic(?:\s+\w+){0,4}\s+(?:formulation|remedy|medicine|recipe|preparation|polyherbal)|polyherbal(?:\s+\w+){0,4}\s+(?:formulation|composition|mixture|medicine|preparation|remedy)|known\s+ayurvedic|old\s+ayurvedic|unmodified\s+(?:classical|ayurvedic|herbal)|exclude\s+traditional\s+medicinal|known\s+properties\s+of\s+(?:traditionally|ayurvedic|plants?)|triphala|chyawanprash|churna|ghrita|taila|asava|arishta|bhasma|rasayana|grandmother|ancestral\s+recipe|family\s+recipe)\b", "Section 3(p) Section 3(e) Patents Act traditional knowledge not patentable aggregation duplication known properties traditionally known component mere admixture"),
    (r"(?i)\b(prohibit(?:s|ed|ing|ion)?|banned|forbidden|not\s+patentable|excluded\s+from\s+patentability|inventions\s+not\s+patentable|what\s+are\s+not\s+inventions)\b", "Section 3 Patents Act not patentable excluded from patentability traditional knowledge known properties mere admixture"),
    (r"(?i)\b(rule\s+161|labelling\s+requirements|label(?:s|ling)?\s+(?:for|of)\s+ayurvedic|particulars\s+(?:displayed\s+on\s+label|on\s+container)|botanical\s+names\s+of\s+ingredients|true\s+list\s+of\s+ingredients)\b", "Rule 161 Rule 161A Part XVII Drugs and Cosmetics Rules labelling packing particulars ingredients botanical names container Ayurvedic Siddha Unani"),
    (r"(?i)\b(rule\s+158b?|difference\s+between\s+classical\s+and\s+proprietary|licens(?:e|ing)\s+requirements|asu\s+drug\s+licen[sc]e|manufacturing\s+licen[sc]e|drug\s+licen[sc]e|first\s+schedule\s+books)\b", "Rule 158B First Schedule authoritative books classical formulation patent or proprietary ASU medicine Section 3(h)"),
    (r"(?i)\b(adulterated\s+ayurvedic|penalties\s+for\s+adulterated|spurious\s+ayurvedic)\b", "Section 33EEC Section 33EE adulterated drugs penalties Ayurvedic ASU"),
    (r"(?i)\b(phytopharmaceutical\s+drugs?|clinical\s+trials?\s+phytopharmaceutical|purified\s+fraction)\b", "Phytopharmaceutical Drugs Guidance clinical trials safety data purified fraction novel drug"),
    (r"(?i)\b(national\s+biodiversity\s+authority|nba\s+approval|patent\s+under\s+section\s+6|patent\s+application\s+biological\s+resource)\b", "Section 6 Section 19 Biological Diversity Act prior approval National Biodiversity Authority patent application"),
    (r"(?i)\b(foreign\s+persons?\s+accessing|foreign\s+entity\s+biological\s+resource|prior\s+approval\s+section\s+3)\b", "Section 3 Biological Diversity Act prior approval foreign persons commercial utilization"),
    (r"(?i)\b(state\s+biodiversity\s+board|sbb\s+notification|notify\s+state\s+biodiversity|collecting\s+medicinal\s+herbs|vaids?\s+(?:and\s+)?hakims?|traditional\s+practitioners?\s+exempt)\b", "Section 7 Section 3 Biological Diversity Act prior intimation State Biodiversity Board vaids hakims local people exempt"),
    (r"(?i)\b(article\s+6\b|access\s+to\s+genetic\s+resources|pic|prior\s+informed\s+consent|mutually\s+agreed\s+terms|mat|nagoya\s+protocol|nagoya)\b", "Article 6 Article 5 Article 7 Nagoya Protocol Access to Genetic Resources Prior Informed Consent PIC Mutually Agreed Terms MAT benefit-sharing sovereign rights"),
    (r"(?i)\b(trips|trips\s+agreement|article\s+27|patentable\s+subject\s+matter|plant\s+varieties|micro[\s-]organisms?|sui\s+generis)\b", "Article 27 Article 27(1) Article 27(3)(b) TRIPS Agreement patentable subject matter novelty inventive step micro-organisms plant varieties sui generis"),
    (r"(?i)\b(pct|patent\s+cooperation\s+treaty|claiming\s+priority|priority\s+claim|international\s+application|pct\s+article\s+8|international\s+search\s+report)\b", "Article 8 Article 11 Article 19 PCT Treaty Claiming Priority international application filing date time limit Paris Convention"),
    (r"(?i)\b(mandatory\s+disclosure|wipo|gratk|genetic\s+resources\s+and\s+associated\s+traditional\s+knowledge|country\s+of\s+origin\s+disclosure|gratk\s+article\s+3|disclosure\s+requirements?)\b", "Article 3 Article 4 Article 5 WIPO GRATK Treaty mandatory disclosure requirement country of origin source genetic resources traditional knowledge patent application"),
    (r"(?i)\b(cbd|convention\s+on\s+biological\s+diversity|sovereign\s+rights|fair\s+benefit\s+sharing|cbd\s+article\s+15|ex[\s-]situ\s+conservation|in[\s-]situ\s+conservation)\b", "Article 15 Article 8(j) Article 19 Convention on Biological Diversity CBD sovereign rights Access to Genetic Resources prior informed consent fair and equitable sharing of benefits"),
    (r"(?i)\b(absolute\s+grounds|grounds\s+for\s+refusal|trademark\s+registration|brand\s+name\s+trademark|logo\s+trademark)\b", "Section 9 Section 11 Trade Marks Act absolute grounds refusal distinctiveness descriptive marks"),
    (r"(?i)\b(geographical\s+indication|gi\s+act|geographical\s+origin|place\s+of\s+origin|regional\s+origin|agricultural\s+(?:goods|products?|crops?|produce)|natural\s+goods|reputation\s+(?:attributable|comes\s+from|linked\s+to)\s+(?:origin|place)|appellation\s+of\s+origin|indication\s+associated\s+with\s+(?:a\s+)?territory|products\s+whose\s+reputation\s+comes\s+from|protects?\s+(?:products|goods)\s+whose\s+reputation)\b", "Section 2(1)(e) Section 2(1)(f) Section 8 Section 11 Geographical Indications Act geographical indication agricultural goods natural goods territory region locality place of origin reputation quality characteristics registration"),
    (r"(?i)\b(section\s+8\s+of\s+the\s+(?:gi|geographical)|who\s+can\s+apply\s+(?:for\s+)?(?:registration\s+of\s+)?gi|apply\s+for\s+(?:a\s+)?geographical\s+indication|registration\s+to\s+be\s+in\s+respect\s+of\s+particular\s+goods|authorised\s+user\s+of\s+a\s+registered\s+geographical)\b", "Section 8 Section 11 Section 17 Geographical Indications Act registration to be in respect of particular goods and area class of goods territory region locality association of persons producers authorised user"),
    (r"(?i)\b(authori[sz]ed\s+user|registration\s+of\s+authori[sz]ed\s+user)\b", "Section 17 Section 2(1)(b) Section 8 Geographical Indications Act authorised user registration registered proprietor"),
    (r"(?i)\b(misleading\s+advertisements?|miraculous\s+cures|magic\s+remedies|false\s+claims\s+ayurvedic)\b", "Section 3 Section 4 Section 5 Drugs and Magic Remedies Act prohibition misleading advertisements magic remedies"),
]

#: (half-open, 0-based page range, name) read from the long drugs act.
DRUG_ACT_PAGES = [
    (5, 10, "act section 3"),
    (24, 37, "act chapter IV-A"),
    (137, 142, "rule 122E"),
    (176, 202, "rules part XVI and XVII"),
    (472, 478, "schedule T"),
]

#: (title, words that select it), first match wins.
PREPARATIONS = [
    ("Taila Kalpana (Medicated Oils / Lipid Formulations)", ["oil", "taila", "thailam", "tailam"]),
    ("Ghrita Kalpana (Medicated Clarified Butter)", ["ghee", "ghrita", "ghritam"]),
    ("Churna Kalpana (Fine Herbal Powders)", ["powder", "churna", "churnam"]),
    ("Asava & Arishta (Self-generated Herbal Fermentations)", ["syrup", "asava", "arishta", "fermented"]),
    ("Lepa Kalpana (Topical Pastes & External Applications)", ["paste", "lepa", "poultice"]),
    ("Vati / Gutika (Classical Herbal Tablets / Pills)", ["tablet", "vati", "gutika", "pill"]),
    ("Avaleha / Rasayana (Herbal Jams & Electuaries)", ["rasayana", "avaleha", "jam", "electuary"]),
    ("Kwatha / Kashayam Kalpana (Aqueous Decoctions)", ["decoction", "kwatha", "kashaya", "kashayam"]),
]
PREPARATION_DEFAULT = "Classical Polyherbal Formulation"

#: (area, words that select it, classes beyond the base one), first match wins.
AREAS = [
    ("Sandhivata & Amavata (Joint Disorders & Musculoskeletal Inflammation)", ["joint", "arthritis", "sandhi", "pain", "knee", "inflammation", "rheumat"], ["A61P 19/02", "A61P 29/00"]),
    ("Kushta & Twak Vikara (Dermatological Disorders & Wound Healing)", ["skin", "eczema", "psoriasis", "twak", "wound", "burn", "kushta"], ["A61P 17/00", "A61K 8/97"]),
    ("Keshya (Hair Care, Scalp Disorders & Follicular Health)", ["hair", "kesha", "keshya", "dandruff", "scalp", "alopecia"], ["A61K 8/97", "A61P 17/14"]),
    ("Agnimandya & Yakrit Vikara (Gastrointestinal & Hepatic Disorders)", ["digest", "gut", "acidity", "liver", "yakrit", "agni", "constipat", "stomach"], ["A61P 1/04", "A61P 1/16"]),
    ("Kasa & Swasa (Respiratory Disorders & Bronchial Conditions)", ["cough", "cold", "asthma", "respiratory", "kasa", "swasa", "bronch"], ["A61P 11/00", "A61P 11/06"]),
    ("Prameha & Madhumeha (Metabolic Disorders & Blood Sugar Regulation)", ["diabetes", "sugar", "prameha", "madhumeha", "metabolic"], ["A61P 3/10"]),
]
AREA_DEFAULT = "General Therapeutics in Classical AYUSH Formulations"
BASE_CLASS = "A61K 36/00"

#: Source texts by school; the oil text is the third of the classical ones where it applies.
CLASSICAL_TEXTS = ["Charaka Samhita", "Sushruta Samhita", "Ashtanga Hridaya of Vagbhata", "Ayurvedic Formulary of India"]
OIL_TEXT = "Sahasrayogam"
UNANI_TEXTS = ["National Formulary of Unani Medicine", "Al-Qanoon fi al-Tibb", "Kitab al-Hawi fi al-Tibb", "Bayaz-e-Kabir"]
SIDDHA_TEXTS = ["Siddha Formulary of India", "Agathiyar Vaidya Rathina Churukkam", "Therayar Maha Karisal", "Bogar 7000"]

#: (question, words for yes, words for no): answers read off a question's text; yes is looked for first.
ABS_ANSWER_WORDS = [
    ("is_sourced_from_india", ["india", "kerala", "western ghats", "himalayas", "domestic"], ["outside india", "foreign country", "imported from", "sourced abroad"]),
    ("is_commercial_use", ["export", "commercial", "sell", "manufacture", "supplement", "market", "product"], ["research only", "pure research", "scientific study", "academic study", "lab trial"]),
    ("is_foreign_entity", ["foreign company", "foreign entity", "multinational", "mnc", "foreign citizen", "nri", "non-resident indian", "foreign owned"], ["indian company", "indian citizen", "domestic entity", "local company", "ayush practitioner", "indian firm"]),
]
YES_WORDS = ["yes", "y", "true", "1"]
ABS_YES_WORDS = ["yes", "y", "true", "1", "commercial", "foreign"]
ABS_NO_WORDS = ["no", "n", "false", "0", "research", "domestic", "indian"]

#: Outcome -> (authority approval, board intimation, provision).
ABS_OUTCOMES = [
    ("not_india", False, False, "Section 3(1) & Section 7(1) read with Section 2(c), Biological Diversity Act, 2002 (as amended 2023)"),
    ("domestic_commercial", False, True, "Section 7(1), Biological Diversity Act, 2002 (as substituted by Biological Diversity (Amendment) Act, 2023) read with State Biodiversity Rules"),
    ("foreign_commercial", True, False, "Section 3(1) read with Section 3(2), Biological Diversity Act, 2002 (as amended 2023) and Rule 13(1), Biological Diversity Rules, 2024"),
    ("domestic_research", False, False, "Section 7(1) (Proviso & A Contrario), Biological Diversity Act, 2002 (as amended 2023)"),
    ("foreign_research", True, False, "Section 3(1), Section 3(2) & Section 5(1), Biological Diversity Act, 2002 (as amended 2023) read with Rule 13(1), BD Rules, 2024"),
    ("undetermined", False, True, "Section 7(1) (Domestic) vs Section 3(1) (Foreign), Biological Diversity Act, 2002 (as amended 2023)"),
]

#: Words that make a short question a follow-up.
ANAPHORA = ["it", "that", "this", "instead", "same", "different", "also"]

#: (pattern, replacement), applied in order; replacements in Java form.
SPEECH_STEPS = [
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"\bTKDL\b", "T K D L, Traditional Knowledge Digital Library"),
    (r"\bABS\b", "A B S, Access and Benefit Sharing"),
    (r"\bNBA\b", "National Biodiversity Authority"),
    (r"\bSBBs?\b", "State Biodiversity Board"),
    (r"\bBMC\b", "Biodiversity Management Committee"),
    (r"\bBDA\b", "Biological Diversity Act"),
    (r"\bAYUSH\b", "Ayush"),
    (r"\bASU\b", "Ayurveda, Siddha, and Unani"),
    (r"\bASU&H\b", "Ayurveda, Siddha, Unani and Homeopathy"),
    (r"\bD&C\b", "Drugs and Cosmetics"),
    (r"\bCDSCO\b", "Central Drugs Standard Control Organisation"),
    (r"\bFSSAI\b", "F S S A I"),
    (r"\bIPC\b", "Indian Pharmacopoeia Commission"),
    (r"\bTRIPS\b", "Trips Agreement"),
    (r"\bCBD\b", "Convention on Biological Diversity"),
    (r"\bGRATK\b", "G R A T K Treaty"),
    (r"\bPCT\b", "Patent Cooperation Treaty"),
    (r"\bWIPO\b", "World Intellectual Property Organization"),
    (r"\bIPR\b", "Intellectual Property Rights"),
    (r"\bFER\b", "First Examination Report"),
    (r"(?i)Section\s+(\d+)\s*\(([a-zA-Z0-9]+)\)\s*\(([a-zA-Z0-9]+)\)", "Section $1 $2 $3"),
    (r"(?i)Section\s+(\d+)\s*\(([a-zA-Z0-9]+)\)", "Section $1 $2"),
    (r"(?i)Rule\s+(\d+)\s*[-–—]\s*([a-zA-Z0-9]+)", "Rule $1 $2"),
    (r"(?i)Rule\s+(\d+)\s*\(([a-zA-Z0-9]+)\)", "Rule $1 $2"),
    (r"(?i)Form\s+(\d+)\s*[-–—]\s*([a-zA-Z0-9]+)", "Form $1 $2"),
    (r"(?i)Form\s+(\d+)([a-zA-Z]+)", "Form $1 $2"),
    (r"\s*\(([0-9]+)\)", " subsection $1"),
    (r"`{1,3}[^`]*`{1,3}", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^#+\s+", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    ("&bull;", " "),
    ("&mdash;", " — "),
    ("&amp;", " and "),
    ("&quot;", '"'),
    ("&apos;", "'"),
    (r"\n+", ". "),
    (r"\s+", " "),
]

#: (words of which one is in the text, words that must be as well, file): the second resolver's order.
CLIENT_FILE_RULES = [
    (["pct", "patent cooperation"], [], "PCT (Patent Cooperation Treaty).pdf"),
    (["gratk"], [], "WIPO GRATK Treaty (2024).pdf"),
    (["nagoya"], [], "Nagoya Protocol.pdf"),
    (["trips", "wto"], [], "trips_agreement.pdf"),
    (["cbd", "convention on biological diversity"], [], "Convention on Biological Diversity (CBD).pdf"),
    (["magic remedies", "dmr", "advertisement"], [], "Drugs and Magic Remedies (Objectionable Advertisements) Act.pdf"),
    (["aahara", "fssai"], [], "Gazette_Notification_Ayurveda_Aahara.pdf"),
    (["phytopharmaceutical", "ipc"], [], "Phytopharmaceutical-Drugs-General-Guidance-for-Development.pdf"),
    (["rule", "diversity"], ["2025"], "The Biological Diversity (Amendment) Rules, 2025.pdf"),
    (["bd rules", "rules, 2024"], [], "The Biological Diversity Rules, 2024.pdf"),
    (["rule"], ["diversity"], "The Biological Diversity Rules, 2024.pdf"),
    (["biological diversity", "bda", "biodiversity"], [], "Biological Diversity (Amendment) Act, 2023.pdf"),
    (["drug", "cosmetic", "d&c", "158-b", "158b", "schedule t", "schedule e"], [], "2016DrugsandCosmeticsAct1940Rules1945.pdf"),
    (["trademark", "trade mark", "tm act"], [], "The Trade Marks Act, 1999.pdf"),
    (["copyright"], [], "The Copyright Act, 1957.pdf"),
    (["geographical indication", "gi act"], [], "Geographical Indications of Goods.pdf"),
    (["design"], [], "The Designs Act, 2000 (Act No. 16 of 2000).pdf"),
]
DEFAULT_FILE = "Patents Act, 1970.pdf"

#: Order of the stages of an answer's event stream.
STAGES = ["detect_language", "translating_query", "abs_compliance", "translating_answer", "classification_check", "tkdl_pointer", "retrieval", "reranking", "synthesis", "llm_token", "complete"]
