"""Fixed values of the data-quality domain: names, word lists, patterns and thresholds.

These lists are part of the results (a token is either a disguised null or it is not), so they are
stated here as plain text and used everywhere from here.
"""

from __future__ import annotations

# Severities, weakest first, and what each costs.
SEVERITIES = ["low", "medium", "high", "critical"]
COLUMN_DEDUCTION = {"critical": 40, "high": 25, "medium": 12, "low": 5}
DATASET_DEDUCTION = {"low": 1, "medium": 3, "high": 7, "critical": 15}
PLAN_GAIN = {"critical": 15, "high": 10, "medium": 5, "low": 2}

# Whitespace as Python's str.strip() sees it. Spark's trim() alone strips only the blank.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Tokens that stand for "no value".
PSEUDO_NULLS = [
    "n/a", "na", "null", "none", "-", "--", "?", "??", "nan", "#n/a", "#na", "missing",
    "unknown", "inconnu", "nd", "nr", "nc", "n.a.", "n.a", "not available",
]

# Tokens that stand for true or false.
BOOLEAN_TOKENS = [
    "yes", "no", "oui", "non", "true", "false", "vrai", "faux", "y", "n", "1", "0", "on", "off",
    "actif", "inactif",
]

# Value formats. \z, not $: Java's $ also matches before a final line break.
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\z",
    "phone": r"^(\+?33|0033|0)[1-9](\s?[0-9]{2}){4}\z",
    "url": r"^https?://[^\s]{3,}\z",
    "postal": r"^[0-9]{5}\z",
    "siret": r"^[0-9]{14}\z",
    "siren": r"^[0-9]{9}\z",
    "ip": r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\z",
}

# Column-name words that promise a format; the first format that fits wins.
FORMAT_WORDS = {
    "email": ["email", "mail", "courriel", "e_mail", "e-mail"],
    "phone": ["phone", "tel", "telephone", "mobile", "portable", "fax"],
    "url": ["url", "web", "site", "link", "href", "website"],
    "postal": ["zip", "postal", "cp", "code_postal", "codepostal", "zipcode"],
    "siret": ["siret"],
    "siren": ["siren"],
}

# Column-name words that hint at a business type; the first type that fits wins.
SEMANTIC_WORDS = {
    "employee_id": ["employee_id", "emp_id", "employe_id", "matricule", "staff_id"],
    "product_code": ["sku", "product_code", "code_produit", "ref_produit", "article_code"],
    "ip_address": ["ip_address", "ip_addr", "adresse_ip"],
    "email": ["email", "mail", "courriel", "e_mail"],
    "phone": ["phone", "tel", "telephone", "mobile", "portable", "cellulaire"],
    "postal_code": ["postal_code", "zip_code", "code_postal", "zipcode"],
    "url": ["url", "website", "site_web", "href"],
    "monetary_amount": [
        "salary", "salaire", "montant", "amount", "price", "prix", "revenue", "revenu", "cost",
        "cout", "wage", "budget", "turnover", "invoice", "facture", "chiffre_affaire",
    ],
    "percentage": ["percentage", "pct", "percent", "taux", "ratio"],
    "age": ["age", "annee_naissance", "birth_year"],
    "date_string": [
        "date", "time", "timestamp", "created_at", "updated_at", "created_on", "updated_on",
        "birth_date", "date_naissance",
    ],
    "boolean_text": [
        "is_active", "is_enabled", "is_deleted", "has_", "flag_", "actif", "active", "enabled",
    ],
    "quantity": ["qty", "quantity", "quantite", "stock", "nb_", "qte", "count"],
    "rating": ["rating", "stars", "grade", "notation", "evaluation"],
    "first_name": ["prenom", "first_name", "firstname", "given_name"],
    "last_name": ["nom_famille", "last_name", "lastname", "surname", "family_name"],
    "full_name": ["full_name", "fullname", "nom_complet", "nom_prenom"],
    "address": ["address", "adresse", "street", "addr"],
    "city": ["city", "ville", "localite", "commune"],
    "country": ["country", "pays", "nation", "country_code"],
    "category": ["category", "categorie", "status", "statut", "class", "genre", "kind"],
    "description": ["description", "desc", "comment", "remarks", "observations"],
}

# Ranges of the bounded business types.
SEMANTIC_RANGES = {"age": (0.0, 150.0), "percentage": (0.0, 100.0), "rating": (0.0, 10.0)}

# Business type -> the format its values must have.
SEMANTIC_FORMATS = {"email": "email", "phone": "phone", "url": "url", "postal_code": "postal"}

# Thresholds of the missing-value check (shares of all rows).
NULL_SHARES = {"high": 0.30, "medium": 0.10, "low": 0.01}

# What an issue type calls for, and whether it can be done without a person.
CORRECTION_ACTIONS = {
    "missing_values": ("impute_median / impute_mode", True),
    "duplicate": ("delete_duplicate_rows", True),
    "type_mismatch": ("cast_to_dominant_type", True),
    "format_error": ("standardize_format", True),
    "anomaly": ("flag_for_review", False),
    "constraint_violation": ("manual_review", False),
    "drift": ("manual_review", False),
    "outlier": ("clip_values", False),
    "inconsistency": ("manual_review", False),
}

# Weights of the confidence factors.
CONFIDENCE_WEIGHTS = {
    "data_quality": 0.25, "sample_size": 0.20, "signal_consistency": 0.25,
    "historical_accuracy": 0.15, "rule_coverage": 0.15,
}

# Population stability index: minor, moderate, major.
PSI_LEVELS = (0.1, 0.25, 0.5)

# Words in a rule text that change how a column is checked.
RULE_REQUIRED_WORDS = ["obligatoire", "required", "non null", "not null"]
RULE_NULLABLE_WORDS = ["optionnel", "nullable", "peut être null"]
RULE_KEY_WORDS = ["identifiant unique", "clé primaire", "primary key", "unique key"]
RULE_STRICT_WORDS = ["format strict", "strict format"]
RULE_UNIQUE_WORDS = ["unique", "unicité"]
RULE_NOT_NULL_WORDS = ["not null", "non null", "obligatoire"]
RULE_POSITIVE_WORDS = ["positif", "positive"]
