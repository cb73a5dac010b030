"""Fixed values of the domain: calling codes, account number lengths, keywords, name parts."""

# Calling codes of the countries covered.
CALLING_CODES = {"966": "SA", "971": "AE", "20": "EG", "964": "IQ", "962": "JO", "965": "KW", "973": "BH"}

# Digits after the country letters, for accounts of digits only.
IBAN_DIGITS = {"SA": 22, "AE": 21, "EG": 27}

# Characters after check digits and four bank letters, for the other countries.
IBAN_AFTER_BANK = {"BH": 14, "IQ": 15, "JO": 22, "KW": 22}

# Words by which ten digits are an identity number.
ID_KEYWORDS = (
    "national id", "id no", "id number", "id:", "iqama", "identity", "identification", "civil id", "civil registry",
    "هوي", "قومي", "بطاقة", "اقامة", "إقامة",
)
ID_BEFORE, ID_AFTER = 60, 20

# Parts of a name that a detected person grows over.
KUNYA = ("أبو", "ابو", "أم", "ام")
NISBAH = ("الدوسري", "العتيبي", "القحطاني", "الحربي", "الشمري", "المطيري", "الغامدي", "الزهراني", "العنزي", "السبيعي")
LAQAB = ("الحاج", "الشيخ", "الأستاذ", "الدكتور", "المهندس")
NAME_PARTS = KUNYA + NISBAH + LAQAB

# Arabic letters and their spelling in chat Latin.
ARABIZI = {"ء": "2", "ع": "3", "ح": "7", "خ": "5", "ص": "9", "ض": "9'", "ط": "6", "ظ": "6'", "ق": "8", "غ": "3'", "ث": "th", "ذ": "th", "ش": "sh", "ة": "a"}

# Mobile prefixes and lengths of national numbers, and bank letters of made-up account numbers.
MOBILE_PREFIXES = {
    "SA": ("50", "53", "55", "56", "59"), "AE": ("50", "52", "54", "55", "56"), "EG": ("10", "11", "12", "15"), "BH": ("36", "37", "38", "39"),
    "IQ": ("770", "771", "750", "780"), "JO": ("79", "78", "77"), "KW": ("50", "51", "55", "60", "65"),
}
NATIONAL_LENGTH = {"SA": 9, "AE": 9, "EG": 10, "BH": 8, "IQ": 10, "JO": 9, "KW": 8}
BANKS = ("BMAG", "RAFB", "NBOK", "CBJO", "ARAB", "NBOB", "BBME", "CIBE")
