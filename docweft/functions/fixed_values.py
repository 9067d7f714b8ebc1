"""Default vocabularies and rule constants. All of them are parameters of the functions that use them."""

# Character equivalents (composed nukta letters to the forms that texts are matched in), as code points because
# the two forms of a pair look alike on a screen.
UNICODE_EQUIVALENTS = [
    ("\u095c", "\u0921\u093c"),
    ("\u095d", "\u0922\u093c"),
    ("\u0958", "\u0915"),
    ("\u095e", "\u092b"),
    ("\u095b", "\u091c"),
    ("\u0931", "\u0930"),
]

# Label spellings and what they become.
LABEL_ALIASES = {
    "विषयक": "विषय:", "विषयः": "विषय:", "पत्र संख्या": "पत्रांक:", "पत्र सं.": "पत्रांक:", "पत्र सं": "पत्रांक:",
    "ज्ञाप संख्या": "ज्ञापांक:", "ज्ञाप सं.": "ज्ञापांक:", "दिनांकित": "दिनांक:", "दिनांकः": "दिनांक:",
    "संदर्भः": "संदर्भ:", "सेवामें": "सेवा में:",
}

# Phrase spellings and what they become.
PHRASE_ALIASES = {
    "के संबंध मे": "के संबंध में", "के सम्बन्ध मे": "के संबंध में", "के सम्बन्ध में": "के संबंध में",
    "के संबंधी में": "के संबंध में", "आवश्यक कार्यवाही": "आवश्यक कार्रवाई",
    "अग्रसारित किया जाता है": "अग्रेषित किया जाता है", "उपरोक्त विषयक": "उपरोक्त विषय के संबंध में",
}
REPEATED_PHRASE = ("उपरोक्त विषय के संबंध में", "के संबंध में")

# Labels of lines.
REFERENCE_LABELS = ["पत्रांक", "ज्ञापांक", "पत्र संख्या", r"पत्र सं\.", "क्रमांक", "reference no", "reference number", "memo no"]
DATE_LABELS = ["दिनांक", "date"]
AUTHORITY_LABELS = ["प्रेषक", "जारीकर्ता", "जारी करने वाला कार्यालय", "issuing authority", "from"]
SUBJECT_LABELS = ["विषय", "विषयक", "subject", r"sub\."]
SUBJECT_STOPS = ["पत्रांक", "ज्ञापांक", "क्रमांक", "दिनांक", "कार्यालय", "विभाग", "सेवा में", "महोदय", "प्रतिलिपि", "प्रति", "संलग्न"]
HEADING_LABELS = ["विषय", "Subject", "क्रमांक", "दिनांक", "सेवा में", "प्रति", "आदेश", "सूचना"]

# Offices that a header line may name, and words that mark an office.
AUTHORITY_HINTS = [
    "बिहार विद्यालय परीक्षा समिति", "शिक्षा विभाग", "बिहार शिक्षा परियोजना परिषद", "जिला शिक्षा पदाधिकारी",
    "प्रखंड शिक्षा पदाधिकारी", "जिला कार्यक्रम पदाधिकारी", "राज्य परियोजना निदेशक", "Bihar School Examination Board",
    "BSEB", "District Education Officer", "Block Education Officer",
]
# Offices that the rule version looks for anywhere in a text, in order.
KNOWN_AUTHORITIES = [
    "बिहार विद्यालय परीक्षा समिति", "बिहार शिक्षा परियोजना परिषद्", "बिहार शिक्षा परियोजना परिषद", "जिला शिक्षा पदाधिकारी",
    "जिला कार्यक्रम पदाधिकारी", "शिक्षा विभाग, बिहार सरकार", "शिक्षा विभाग बिहार सरकार",
]
# The script version's patterns of an issuing office, in order, and openings that are no part of its name.
AUTHORITY_PATTERNS = [
    r"(?:जारी\s*करने\s*वाला\s*कार्यालय|जारीकर्ता\s*कार्यालय|जारी\s*कर्ता|जारी\s*करने\s*वाला|निर्गत\s*कर्ता|निर्गतकर्ता|प्रेषक|प्रेषक\s*कार्यालय|कार्यालय|विभाग|from|issued\s*by|issuing\s*authority|office)\s*[:.\-]?\s*([^\r\n]{3,250})",
    r"((?:शिक्षा\s*विभाग|शिक्षा\s*निदेशालय|माध्यमिक\s*शिक्षा|प्राथमिक\s*शिक्षा|जिला\s*शिक्षा\s*पदाधिकारी|जिला\s*कार्यक्रम\s*पदाधिकारी|जिला\s*शिक्षा\s*कार्यालय|जिला\s*पदाधिकारी|प्रखंड\s*शिक्षा\s*पदाधिकारी|प्रखंड\s*शिक्षा\s*कार्यालय|बिहार\s*विद्यालय\s*परीक्षा\s*समिति|BSEB|Bihar\s*School\s*Examination\s*Board)[^\r\n]{0,180})",
]
GREETINGS = r"^(?:मान्यवर|सेवा\s*में|प्रति|श्रीमान|श्रीमती)\s*[:.\-]?\s*"
# What asks for an action, what makes it immediate, and the text for that.
REQUIRED_ACTION = r"(?:आवश्यक\s*कार्यवाही|आवश्यक\s*कार्रवाई|कार्यवाही\s*करें|कार्रवाई\s*करें|निर्देश|निर्देशित\s*किया\s*जाता\s*है|required\s*action|action\s*required)\s*[:.\-]?\s*([^\r\n]{5,400})"
IMMEDIATE = r"अविलंब|तत्काल|अत्यावश्यक|शीघ्र|सत्वर|तुरंत|urgent|immediately"
IMMEDIATE_ACTION = "Immediate action required"
# The special subject of the rule version, by pattern.
SPECIAL_SUBJECT = (
    r"स्पॉट\s*नामांकन|Spot\s*Admission",
    "सत्र 2026-28 के लिए इंटरमीडिएट कक्षा में स्पॉट नामांकन (Spot Admission) हेतु तिथि विस्तारित करने के संबंध में सूचना",
)
# Three-way categories of the rule version (pattern, key, label); anything else is other.
CATEGORY_RULES = [
    (r"स्पॉट\s*नामांकन|नामांकन|admission|OFSS", "admission", "Admission"),
    (r"बिहार\s*विद्यालय\s*परीक्षा\s*समिति|BSEB", "bseb", "BSEB"),
]
# Taxonomy keys of lower-case labels; any other label is "other".
TAXONOMY_KEYS = {
    "bseb": "bseb", "examination": "examination", "registration": "registration", "student": "student", "admission": "admission",
    "payment / fee": "payment_fee", "scholarship": "scholarship", "udise": "udise", "school administration": "school_administration",
    "teacher / staff": "teacher_staff", "attendance": "attendance", "infrastructure": "infrastructure", "building / repair": "building_repair",
    "inspection": "inspection", "meeting": "meeting", "training": "training", "government order": "government_order",
    "district office": "district_office", "block office": "block_office", "notice / circular": "notice_circular", "academic": "academic",
    "computer science": "computer_science", "data submission": "data_submission", "portal / technical issue": "portal_technical",
    "deadline / urgent action": "deadline_urgent", "finance / accounts": "finance_accounts", "procurement": "procurement",
    "general information": "general_information",
}
# Labels of document types; any other type is its own name in title case.
TYPE_LABELS = {
    "admission": "Admission", "examination": "Examination", "transfer": "Transfer", "service": "Service", "training": "Training",
    "scholarship": "Scholarship", "holiday": "Holiday", "other": "Other",
}
# The two forms of a templated description, around subject and action, and around category and subject.
DESCRIPTION_WITH_ACTION = ("", "। पत्र में संबंधित कार्यवाही/निर्देश के रूप में ", "।")
DESCRIPTION_PLAIN = ("यह दस्तावेज़ ", " संबंधी सूचना/निर्देश से संबंधित है: ", ".")

# Words of lines that name an office, and of lines that do not.
OFFICE_WORDS = ["समिति", "परिषद्", "परिषद", "कार्यालय", "पदाधिकारी", "विभाग", "सरकार", "शिक्षा भवन"]
NOT_OFFICE_WORDS = ["विषय", "subject", "पत्रांक", "दिनांक", "प्रसंग", "के संबंध में", "संबंधी आवश्यक"]

# Canonical office names, in order; patterns to names.
AUTHORITY_NAMES = [
    (r"बिहार\s*विद्यालय\s*परीक्षा\s*समिति|BSEB|Bihar\s*School\s*Examination\s*Board", "BSEB"),
    (r"जिला\s*शिक्षा\s*पदाधिकारी|District\s*Education\s*Officer", "District Education Office"),
    (r"जिला\s*शिक्षा\s*कार्यालय|District\s*Education\s*Office", "District Education Office"),
    (r"जिला\s*कार्यक्रम\s*पदाधिकारी", "District Programme Officer"),
    (r"जिला\s*पदाधिकारी|District\s*Magistrate", "District Magistrate"),
]

# Terms that point to a document type, in order of preference on ties.
TYPE_RULES = {
    "admission": ["स्पॉट नामांकन", "नामांकन", "OFSS", "spot admission", "admission"],
    "examination": ["परीक्षा", "परीक्षार्थी", "परीक्षा कार्यक्रम", "result", "परिणाम", "exam"],
    "transfer": ["स्थानांतरण", "स्थानान्तरण", "पदस्थापन", "transfer"],
    "service": ["सेवा इतिहास", "सेवा संबंधी", "सेवाकाल", "service"],
    "training": ["प्रशिक्षण", "training"],
    "scholarship": ["छात्रवृत्ति", "scholarship"],
    "holiday": ["अवकाश", "holiday"],
}

# Categories by pattern, in order; anything else is "Other".
CATEGORY_CASCADE = [
    (r"बिहार\s*विद्यालय\s*परीक्षा\s*समिति|BSEB|बोर्ड\s*परीक्षा|मैट्रिक|माध्यमिक\s*परीक्षा", "BSEB"),
    (r"जिला\s*शिक्षा|जिला\s*कार्यक्रम|प्रखंड\s*शिक्षा|District\s*Education", "District Office"),
    (r"जिला\s*पदाधिकारी|District\s*Magistrate|डीएम|DM", "Government Order"),
    (r"वेतन|salary|पेंशन|pension|स्थापना|service\s*book|सेवा\s*पुस्तिका", "Service / Establishment"),
    (r"छात्रवृत्ति|scholarship|नामांकन|admission|पंजीयन|registration|छात्र|student", "Student / Registration"),
    (r"परीक्षा|exam|मूल्यांकन|evaluation|result|परिणाम", "Examination"),
]
# Words that make a letter urgent.
URGENT = r"अविलंब|तत्काल|अत्यावश्यक|शीघ्र|सत्वर|तुरंत|urgent|immediately|last\s*date|अंतिम\s*तिथि|अंतिम\s*दिन"

# Lines that ask for something.
ACTION_PATTERNS = [
    r"(?:सूचित|निर्देशित|अनुरोध|आदेश)\s+(?:किया|करते|दिया|गया)",
    r"(?:करना|करें|कराया|लेने|जमा करने|प्रदर्शित करने)\s+(?:होगा|होगी|करेंगे|करें)",
    r"(?:तक|दिनांक)\s+(?:विस्तारित|निर्धारित|निश्चित)",
]

# States of processing and storage that count as failed.
FAILED_PROCESSING = ["Processing Failed", "Needs Manual Review", "Action Required"]
FAILED_STORAGE = ["Processing Failed", "Storage Failed", "Failed", "Error"]
FAILED_STORAGE_IN_PLANS = ["Processing Failed", "Failed", "Error"]

# Intake states that wait for something.
OPEN_INTAKE = ["Received", "Stored", "Processing Failed", "Storage Failed", "Storage Partial"]

# Minutes after which a stage counts as stalled.
STAGE_MINUTES = {"intake": 10, "stored": 20, "processing": 30, "published": 15}

# Patterns of the script version for reference numbers, dates and subjects, in order; group 1 is the value.
REFERENCE_PATTERNS = [
    r"(?:पत्रांक|पत्र\s*संख्या|ज्ञापांक|ज्ञापन\s*संख्या|क्रमांक|क्र\.\s*सं\.|memo\s*(?:no|number)|letter\s*(?:no|number)|ref(?:erence)?\s*(?:no|number))\s*[:.\-]?\s*([A-Za-z0-9अ-ह०-९/_()\-.]+)",
    r"(?<![\p{L}\p{N}_])(?:No\.?|संख्या)\s*[:.]?\s*([A-Za-z0-9/_()\-.]{3,})",
]
DATE_PATTERNS = [
    r"(?:दिनांक|दिनांक\s*:-|तिथि|जारी\s*दिनांक|पत्र\s*दिनांक|date)\s*[:.\-]?\s*([0-9०-९]{1,2}[/.\-][0-9०-९]{1,2}[/.\-][0-9०-९]{2,4})",
    r"(?:दिनांक|date)\s*[:.\-]?\s*([0-9०-९]{1,2}\s+[A-Za-z]{3,12}\s+[0-9०-९]{4})",
]
SUBJECT_PATTERNS = [
    r"(?:विषय|विषयक|subject)\s*[:.\-]?\s*([^\r\n]{5,500})",
    r"(?:संबंधित\s*विषय)\s*[:.\-]?\s*([^\r\n]{5,500})",
]
# Patterns of labelled deadlines and of any labelled date; group 1 is the date.
DEADLINE_PATTERNS = [
    r"(?:अंतिम\s*तिथि|अंतिम\s*दिन|अंतिम\s*तारीख|last\s*date|deadline|due\s*date)\s*[:.\-]?\s*([0-9०-९]{1,2}[/.\-][0-9०-९]{1,2}[/.\-][0-9०-९]{2,4})",
    r"(?:दिनांक|date)\s*[:.\-]?\s*([0-9०-९]{1,2}[/.\-][0-9०-९]{1,2}[/.\-][0-9०-९]{2,4})",
]
# Words of a line that states a matter, labels of lines that do not, labels that end a subject.
MATTER_WORDS = r"संबंध में|हेतु|बारे में|सूचना|आवश्यकता"
OTHER_LABELS = r"^(?:प्रेषक|जारीकर्ता|पत्रांक|दिनांक)"
AFTER_SUBJECT = ["प्रसंग", "दिनांक", "पत्रांक", "reference", "memo"]
# The sentence on a sender; the detailed description: its frame, and for subject, authority and date what stands
# before the value and what stands for a missing one.
DESCRIPTION_OF_SENDER = "Official communication from "
DETAILED_FRAME = (("यह दस्तावेज़ ", " के रूप में प्राप्त हुआ। "), "OCR/पाठ निष्कर्षण के आधार पर विवरण तैयार किया गया है.")
DETAILED_PARTS = [
    ("विषय: ", "विषय स्वतः निर्धारित नहीं हो सका। "),
    ("जारीकर्ता: ", "जारीकर्ता स्वतः निर्धारित नहीं हो सका। "),
    ("जारी तिथि: ", "जारी तिथि स्वतः निर्धारित नहीं हो सकी। "),
]
