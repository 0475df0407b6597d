"""Vocabulary tables of the engine. They decide which results are right."""

PRIORITY = {
    "EMAIL_ADDRESS": 9, "US_SSN": 9, "IN_PAN": 9, "PL_PESEL": 9, "PASSPORT": 9, "CREDIT_CARD": 9, "IBAN_CODE": 9, "EMPLOYEE_ID": 9, "VENDOR_ID": 8,
    "TAX_ID": 8, "NATIONAL_ID": 8, "DATE_OF_BIRTH": 7, "PHONE_NUMBER": 6, "ADDRESS": 5, "PERSON": 4, "LOW_CONFIDENCE_OCR": 1, "IN_AADHAAR": 9,
    "IP_ADDRESS": 8, "CREDENTIAL": 10, "UPI_ID": 9, "UK_NINO": 9, "DRIVING_LICENCE": 9, "IN_VOTER_ID": 8, "BANK_ACCOUNT": 7, "HEALTH_DATA": 5, "CONFIDENTIAL_TERM": 10,
}
SENSITIVITY = {
    "CREDENTIAL": 10, "US_SSN": 10, "PASSPORT": 10, "NATIONAL_ID": 10, "IN_AADHAAR": 10, "PL_PESEL": 10, "CREDIT_CARD": 9, "IBAN_CODE": 8, "IN_PAN": 8,
    "TAX_ID": 7, "DATE_OF_BIRTH": 6, "ADDRESS": 5, "PHONE_NUMBER": 4, "EMAIL_ADDRESS": 4, "PERSON": 3, "IP_ADDRESS": 3, "EMPLOYEE_ID": 3, "VENDOR_ID": 1,
    "BANK_ACCOUNT": 8, "UPI_ID": 5, "DRIVING_LICENCE": 9, "IN_VOTER_ID": 9, "UK_NINO": 10, "HEALTH_DATA": 9, "CONFIDENTIAL_TERM": 7, "LOW_CONFIDENCE_OCR": 2,
}
DEFAULT_SENSITIVITY = 3
SHORT_NAMES = {
    "PERSON": "PERSON", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "EMPLOYEE_ID": "EMP_ID", "VENDOR_ID": "VENDOR_ID", "US_SSN": "SSN",
    "PASSPORT": "PASSPORT", "IN_PAN": "PAN", "PL_PESEL": "PESEL", "TAX_ID": "TIN", "NATIONAL_ID": "NATIONAL_ID", "CREDIT_CARD": "CARD", "IBAN_CODE": "IBAN",
    "DATE_OF_BIRTH": "DOB", "ADDRESS": "ADDRESS", "LOW_CONFIDENCE_OCR": "UNREADABLE", "IN_AADHAAR": "AADHAAR", "IP_ADDRESS": "IP", "CREDENTIAL": "SECRET",
    "BANK_ACCOUNT": "BANK", "UPI_ID": "UPI", "DRIVING_LICENCE": "DL", "IN_VOTER_ID": "VOTER_ID", "UK_NINO": "NINO", "HEALTH_DATA": "HEALTH", "CONFIDENTIAL_TERM": "TERM",
}
#: What replaces a value, by profile and category; categories not named are tokenised.
PROFILES = {
    "default": {},
    "gdpr": {"DATE_OF_BIRTH": "year", "HEALTH_DATA": "mask", "CREDENTIAL": "mask"},
    "dpdp": {"IN_AADHAAR": "last4", "DATE_OF_BIRTH": "year", "HEALTH_DATA": "mask", "CREDENTIAL": "mask"},
    "pci": {"CREDIT_CARD": "last4", "BANK_ACCOUNT": "last4", "IBAN_CODE": "last4", "CREDENTIAL": "mask"},
}
CONTEXT_WORDS = {
    "US_SSN": ["ssn", "social security", "social sec", "ss#", "ss no"],
    "PASSPORT": ["passport", "passport no", "passport number", "travel document"],
    "IN_PAN": ["pan", "permanent account", "income tax", "pan no", "pan card"],
    "PL_PESEL": ["pesel", "national id", "polish id", "nat. id"],
    "TAX_ID": ["tin", "tax id", "taxpayer", "nip", "ein", "tax identification", "vat"],
    "CREDIT_CARD": ["card", "credit", "debit", "visa", "mastercard", "amex", "pan", "ending", "cardholder"],
    "PHONE_NUMBER": ["phone", "mobile", "tel", "telephone", "cell", "call", "contact", "fax", "ext", "whatsapp"],
    "DATE_OF_BIRTH": ["dob", "d.o.b", "date of birth", "born", "birth date", "birthdate", "birthday", "age"],
    "IBAN_CODE": ["iban", "account", "bank"],
    "IN_AADHAAR": ["aadhaar", "aadhar", "uid", "uidai", "unique id"],
    "IP_ADDRESS": ["ip", "ip address", "host", "server", "client", "source", "login from"],
    "CREDENTIAL": ["key", "api key", "apikey", "secret", "token", "password", "passwd", "pwd", "credential"],
    "BANK_ACCOUNT": ["account", "a/c", "acct", "bank", "ifsc", "sort code", "routing", "beneficiary", "savings", "current account"],
    "UK_NINO": ["national insurance", "nino", "ni number", "ni no"],
}
REDACT, REVIEW = 0.60, 0.35
CONTEXT_BOOST, NO_CONTEXT_CAP, BEFORE, AFTER = 0.35, 0.2, 45, 20
#: exposure rating: weight of one value that makes a file critical; score per thousand words for high and medium
CRITICAL_WEIGHT, HIGH_DENSITY, MEDIUM_DENSITY = 9, 25.0, 5.0
#: share of instances that detection misses
MISS_PERSON, MISS_OTHER = 25 / 115, 3 / 104
