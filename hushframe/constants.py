"""Entity types, word lists, name pools, labels and limits.

They have to equal the values the results are compared with, so they are written out as text.
"""

# Entity types that are kept after detection.
KEPT_TYPES = [
    "PERSON", "AT_IBAN", "IBAN_CODE", "PHONE_NUMBER", "AT_UID_NR", "AT_SVNR",
    "AT_FIRMENBUCH_NR", "EMAIL_ADDRESS", "DOC_METADATA", "ORGANIZATION", "ORG",
    "CREDIT_CARD", "CUSTOM", "CREDENTIAL", "EU_PII", "SENSITIVE_DATA",
]

# Product names that are no persons.
PRODUCT_NAMES = [
    "claude", "claude code", "chatgpt", "copilot", "gemini", "siri", "alexa", "cortana",
    "watson", "deepmind", "midjourney", "dall-e", "whisper", "presidio", "tesseract",
    "ollama", "langchain", "fastapi",
]

# Abbreviations that are no places.
NO_PLACES = [
    "tel", "tel.", "dr", "dr.", "nr", "nr.", "str", "str.", "gmbh", "ag", "kg", "og", "e.u.",
    "eur", "usd", "chf", "bic", "iban", "svnr", "sv-nr", "uid", "fn", "mrt", "ct", "ekg",
]

# Colours of the marked-up text.
TYPE_COLOURS = {
    "PERSON": "#3b82f6",
    "AT_IBAN": "#22c55e",
    "IBAN_CODE": "#22c55e",
    "PHONE_NUMBER": "#f97316",
    "AT_UID_NR": "#a855f7",
    "AT_SVNR": "#ef4444",
    "AT_FIRMENBUCH_NR": "#ec4899",
    "LOCATION": "#14b8a6",
    "DATE_TIME": "#eab308",
    "EMAIL_ADDRESS": "#6366f1",
    "ORGANIZATION": "#06b6d4",
    "NRP": "#84cc16",
    "CREDIT_CARD": "#f43f5e",
    "DOC_METADATA": "#d946ef",
}
OTHER_COLOUR = "#9ca3af"

# The three codename pools, in the order they are handed out.
PERSON_NAMES = [
    "Arion", "Brynn", "Cael", "Dara", "Eryx", "Fael", "Gwyn", "Hale", "Ilan", "Jael",
    "Kael", "Lior", "Mael", "Nyra", "Orin", "Penn", "Quinn", "Rael", "Soren", "Tarn",
    "Ulla", "Vale", "Wren", "Xael", "Yael", "Zeph", "Alix", "Bron", "Cyra", "Dex",
    "Eira", "Fenn", "Gael", "Hart", "Iona", "Juno", "Kyro", "Lyra", "Mira", "Neva",
]
ORG_NAMES = [
    "Nexon Corp", "Velar AG", "Talon GmbH", "Prism Group", "Helix AG", "Corvus GmbH",
    "Aether Corp", "Zenith AG", "Vortex GmbH", "Apex Group", "Cipher AG", "Dynex Corp",
    "Embark GmbH", "Forge AG", "Glint Corp", "Ivory GmbH", "Kinex AG", "Lumin Corp",
    "Nova GmbH", "Onyx Group", "Pulse AG", "Quasar Corp", "Rune GmbH", "Synth AG", "Titan Corp",
]
CUSTOM_NAMES = [
    "Projekt Nox", "Vorhaben Vex", "Initiative Lux", "Programm Zar", "Konzept Dyn",
    "Entwurf Orx", "Plan Kyr", "Schema Tyr", "Modell Fen", "Protokoll Ash", "Rahmen Sol",
    "Leitfaden Pax", "Ansatz Vyn", "Methode Rex", "Verfahren Kor", "Strategie Bel",
]
POOLS = {"PERSON": PERSON_NAMES, "ORG": ORG_NAMES, "CUSTOM": CUSTOM_NAMES}
# Which types draw from which pool; every other type is numbered in brackets.
POOL_OF_TYPE = {
    "PERSON": "PERSON", "DOC_METADATA": "PERSON",
    "ORGANIZATION": "ORG", "ORG": "ORG",
    "CUSTOM": "CUSTOM",
}

# First names that count as a person when written with a capital letter.
FIRST_NAMES = [
    "anna", "maria", "laura", "julia", "sarah", "sabine", "petra", "claudia", "monika",
    "andrea", "katharina", "elisabeth", "christine", "stefanie", "barbara", "nicole",
    "sandra", "martina", "susanne", "gabriele", "birgit", "angelika", "heike", "eva", "karin",
    "renate", "ursula", "ingrid", "helga", "silvia", "sonja", "lisa", "lena", "sophie", "emma",
    "mia", "hannah", "leonie", "marie", "johanna", "franziska", "verena", "diana", "melanie",
    "nadine", "simone", "jasmin", "manuela", "daniela", "cornelia", "doris", "margit", "anja",
    "tanja", "heidi", "ilse", "herta", "gisela", "gertrude", "brigitte", "irmgard",
    "hildegard", "rosa", "theresia", "margarete", "frieda", "paula", "nina",
    "thomas", "michael", "andreas", "peter", "stefan", "markus", "christian", "martin",
    "daniel", "wolfgang", "robert", "johannes", "alexander", "bernhard", "franz", "josef",
    "karl", "helmut", "gerhard", "werner", "manfred", "hans", "heinz", "herbert", "walter",
    "georg", "rudolf", "friedrich", "wilhelm", "ernst", "heinrich", "otto", "klaus", "dieter",
    "horst", "jürgen", "rainer", "uwe", "frank", "bernd", "matthias", "florian", "sebastian",
    "david", "lukas", "felix", "tobias", "simon", "philipp", "benjamin", "maximilian",
    "moritz", "leon", "paul", "jakob", "elias", "noah", "jonas", "luca", "nico", "tim", "jan",
    "max", "oliver", "patrick", "christoph", "dominik", "mario", "rene", "harald", "günter",
    "leopold", "erich", "erwin", "alois", "alfred", "hermann", "oskar", "hubert",
]
# Words that make a following first name more certain.
NAME_CONTEXT = (
    r"herr|frau|dr\.|prof\.|mag\.|ing\.|kollege|kollegin|freund|freundin|mitarbeiter|"
    r"mitarbeiterin|kunde|kundin|patient|patientin|chef|chefin|liebe[r]?|geschätzte[r]?"
)

# Sensitivity categories and their display labels.
CATEGORY_LABELS = {
    "BUSINESS_SECRET": "Geschaeftsgeheimnis & Vertrauliche Information",
    "ARCHITECTURE": "Softwarearchitektur & Systemdesign",
    "CREDENTIALS": "Zugangsdaten & Schluessel",
    "FINANCIAL": "Finanzdaten & Kalkulation",
    "LEGAL": "Rechtliche Dokumente & Vertraege",
    "HR_INTERNAL": "Personalwesen & Interne Beurteilungen",
    "MEDICAL": "Medizinische Daten & Befunde",
}
# Descriptions a text encoder turns into the category vectors.
CATEGORY_DESCRIPTIONS = {
    "BUSINESS_SECRET": "Geschaeftsgeheimnis, vertrauliche Geschaeftsinformation, interne Strategie, Wettbewerbsvorteil",
    "ARCHITECTURE": (
        "Softwarearchitektur, Systemdesign, technische Infrastruktur, Datenbankschema, API-Dokumentation, "
        "Deployment-Konfiguration"
    ),
    "CREDENTIALS": "Passwort, Zugangsdaten, API-Key, Secret, Token, Schluessel, Private Key, Zertifikat",
    "FINANCIAL": (
        "Finanzbericht, Bilanz, Umsatz, Gewinn, Budget, Gehalt, Kostenkalkulation, Preiskalkulation"
    ),
    "LEGAL": "Vertrag, Geheimhaltungsvereinbarung, NDA, Compliance, Rechtsstreit, Klage, Patent",
    "HR_INTERNAL": (
        "Mitarbeiterbewertung, Kuendigung, Abmahnung, Personalakte, Gehaltsverhandlung, interne Beurteilung"
    ),
    "MEDICAL": "Diagnose, Befund, Therapie, Medikation, Patientenakte, Krankengeschichte",
}
# Words that flag a text at once.
FLAG_WORDS = [
    "vertraulich", "geheim", "intern", "nicht weitergeben", "api-key", "passwort", "password",
    "secret", "token", "private key",
]
FLAG_WORD_SCORE = 0.9
EXCERPT_BEFORE, EXCERPT_AFTER, EXCERPT_MAX = 50, 150, 200
CATEGORY_THRESHOLD, HIGH_RISK_SCORE, MEDIUM_RISK_SCORE, CHUNK_CHARS = 0.50, 0.7, 0.6, 200

# Report sentences.
SUMMARY_BLANK = "Kein Text zur Analyse vorhanden."
SUMMARY_NONE = "Keine sensiblen Inhalte erkannt."
SUMMARY_HIGH = (
    "Vertraulicher Inhalt erkannt (",
    "). Daten werden vor dem Senden vollstaendig anonymisiert.",
)
SUMMARY_OTHER = ("Moeglicherweise sensibel: ", ".")

# File formats by extension and by MIME type.
FORMAT_OF_EXTENSION = {
    ".pdf": "PDF", ".docx": "DOCX", ".xlsx": "XLSX",
    ".txt": "TEXT", ".csv": "TEXT", ".md": "TEXT", ".json": "TEXT", ".xml": "TEXT", ".html": "TEXT",
    ".png": "IMAGE", ".jpg": "IMAGE", ".jpeg": "IMAGE", ".tiff": "IMAGE", ".tif": "IMAGE",
    ".bmp": "IMAGE", ".webp": "IMAGE",
}
FORMAT_OF_MIME = {
    "application/pdf": "PDF",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX",
    "text/plain": "TEXT", "text/csv": "TEXT", "text/markdown": "TEXT", "text/html": "TEXT",
    "text/xml": "TEXT", "application/json": "TEXT", "application/xml": "TEXT",
    "image/png": "IMAGE", "image/jpeg": "IMAGE", "image/tiff": "IMAGE", "image/bmp": "IMAGE",
    "image/webp": "IMAGE",
}

# Limits.
MAX_REQUEST_CHARS = 2000
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_FILE_CHARS = 50_000
SESSION_TTL_SECONDS = 1800
KEY_LIMIT, DAY_LIMIT, MIN_GAP_SECONDS = 20, 200, 1.0
CONFIDENCE = 0.6
TERM_MIN_CHARS, TERM_MAX_COUNT, TERMS_PER_TEXT, TERM_SIMILARITY = 4, 3, 25, 0.72

# Kinds a document classifier may answer with.
DOC_KINDS = [
    "brief", "vertrag", "medizinisch", "technisch", "finanzbericht", "rechnung", "bewerbung",
    "protokoll", "gutachten", "sonstiges",
]
DEFAULT_KIND = "sonstiges"

# Fixed value: hint added to the system turn when bracket codenames are used.
BRACKET_HINT = (
    "The text contains reference codes in square brackets "
    "(e.g. [AT_IBAN_1], [PHONE_NUMBER_1]). "
    "Reproduce these EXACTLY as they appear."
)

# Terms that never count as identifying.  The list is a parameter of the learner (``stop_terms``).
DEFAULT_STOP_TERMS = [
    # general words
    "herr", "frau", "sehr", "geehrte", "geehrter", "liebe", "lieber", "firma", "unternehmen", "person", "name",
    "adresse", "telefon", "bitte", "danke", "freundliche", "grüße", "gruesse", "erstellt", "verfasst", "geschrieben",
    "bearbeitet", "dokument", "brief", "vertrag", "rechnung", "angebot", "beispiel", "standard", "optional",
    "alternative", "ergebnis", "tabelle", "abbildung", "anhang", "kapitel", "abschnitt", "deutsch", "deutsche",
    "deutscher", "deutsches", "deutschen", "oesterreichisch", "oesterreichische", "oesterreichischen",
    # legal forms
    "gmbh", "ag", "kg", "e.u.", "ohg", "mbh", "corp", "inc", "ltd",
    # calendar
    "januar", "februar", "märz", "maerz", "april", "mai", "juni", "juli", "august", "september", "oktober",
    "november", "dezember", "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag",
    # places
    "österreich", "oesterreich", "deutschland", "schweiz", "europa", "wien", "berlin", "münchen", "muenchen",
    "zürich", "zuerich", "hamburg", "köln", "koeln", "frankfurt", "salzburg", "graz", "linz",
    # money and law
    "eur", "usd", "chf", "gbp", "jpy", "cny", "euro", "uid", "iban", "bic", "svnr", "swift", "sepa", "mwst", "ust",
    "vat", "netto", "brutto", "abs", "bgb", "dsgvo", "gdpr", "dsg",
    # parts of a letter
    "tel", "fax", "mobil", "mail", "email", "nr", "nr.", "str", "str.", "plz",
    # products
    "claude", "openai", "anthropic", "gemini", "mistral", "llama", "chatgpt", "copilot", "alexa", "siri", "cortana",
    "google", "microsoft", "apple", "amazon", "meta", "nvidia", "docker", "kubernetes", "linux", "windows", "macos",
    "android", "python", "javascript", "typescript", "java", "rust", "golang", "fastapi", "flask", "django",
    "express", "react", "angular", "vue", "spacy", "presidio", "tesseract", "ollama", "litellm", "langchain",
    "pytorch", "tensorflow", "numpy", "pandas", "scipy", "sqlite", "postgres", "postgresql", "mysql", "mongodb",
    "redis", "chromadb", "pinecone", "weaviate", "qdrant", "milvus", "github", "gitlab", "bitbucket", "jira",
    "confluence", "hetzner", "aws", "azure", "gcloud", "vercel", "netlify", "cloudflare", "nginx", "apache",
    "caddy", "whisper", "stable diffusion", "midjourney", "dall-e",
    # technical terms
    "llm", "ner", "nlp", "ocr", "api", "sdk", "cli", "gui", "ide", "gpu", "cpu", "ram", "rom", "ssd", "hdd", "vps",
    "tls", "ssl", "ssh", "dns", "cdn", "dpi", "fps", "url", "uri", "pdf", "png", "jpg", "jpeg", "tiff", "bmp",
    "webp", "svg", "xlsx", "csv", "docx", "json", "xml", "yaml", "toml", "html", "rest", "graphql", "grpc", "mqtt",
    "websocket", "pip", "npm", "yarn", "cargo", "brew", "apt", "git", "svn", "mercurial", "http", "https", "ftp",
    "smtp", "imap", "regex", "pattern", "token", "embedding", "vector", "tensor", "prompt", "query", "response",
    "request", "endpoint", "layer", "model", "module", "plugin", "extension", "pipeline", "workflow", "trigger",
    "hook", "callback", "mapping", "schema", "migration", "fixture", "seed", "cache", "proxy", "gateway", "bridge",
    "adapter", "memory", "buffer", "queue", "stack", "heap", "scan", "chunk", "batch", "stream", "shard", "open",
    "source", "free", "premium", "enterprise", "detection", "analysis", "processing", "extraction", "generation",
    "setup", "config", "install", "deploy", "build", "test", "benchmark", "performance", "upgrade", "downgrade",
    "design", "core", "base", "main", "init", "auto", "true", "false", "null", "none", "undefined", "remote",
    "local", "global", "private", "public", "clone", "fork", "merge", "rebase", "commit", "push", "pull",
    # short words
    "mit", "und", "oder", "bei", "von", "fuer", "aus", "auf", "per", "pro", "max", "min", "neu", "alt", "gut",
    "text", "code", "data", "file", "log", "key", "tag",
]
