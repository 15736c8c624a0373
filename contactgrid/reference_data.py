"""Fixed values the operators rely on: code lists, word lists, weights and messages.

Everything here is plain data. Operators turn the small sets into `isin` predicates (compiled by
Catalyst into hash-set lookups) or into literal maps, so no lookup table is ever shuffled.
"""

from __future__ import annotations

# --- fixed values: address normalization -----------------------------------------------------
NORMALIZATION_MESSAGES = {
    "EMPTY_INPUT": "A URL is required.",
    "INPUT_TOO_LONG": "The URL is too long.",
    "INVALID_URL": "The URL could not be parsed.",
    "UNSUPPORTED_SCHEME": "Only HTTP and HTTPS URLs are supported.",
    "CREDENTIALS_NOT_ALLOWED": "Credentials are not allowed in URLs.",
    "MISSING_HOST": "The URL must contain a hostname.",
    "INVALID_PORT": "The URL contains an invalid port.",
}
BAD_HOST_MESSAGE = "The hostname contains invalid characters."

# --- fixed values: address cleaning ----------------------------------------------------------
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gclid", "dclid", "fbclid", "msclkid",
)
PLATFORM_DOMAINS = (
    "google.com", "google.co.uk", "google.com.pk", "google.ca", "google.de", "google.fr",
    "google.es", "google.it", "google.co.jp", "google.com.au", "google.com.br",
    "google.com.mx", "google.com.ar", "googleadservices.com",
)
LOOKALIKE_PREFIXES = (
    "google.com.", "google.co.", "google.ca.", "google.de.", "support.google.",
    "accounts.google.", "policies.google.", "maps.google.",
)
UNRELATED_PLATFORM_CODES = (
    "SEARCH_ENGINE_PAGE", "MAPS_OR_DIRECTIONS", "ADVERTISEMENT_OR_TRACKING_REDIRECT",
    "ACCOUNT_OR_AUTH_PAGE", "SUPPORT_OR_HELP_PAGE", "PRIVACY_TERMS_OR_POLICY_PAGE",
    "NON_TARGET_PLATFORM_PAGE",
)
DECISION_LABELS = {
    "READY_TO_CHECK": "Ready to check",
    "NEEDS_REVIEW": "Review recommended",
    "DUPLICATE_URL": "Duplicate website",
    "DUPLICATE_DOMAIN": "Duplicate website",
    **{code: "Unrelated platform link" for code in UNRELATED_PLATFORM_CODES},
    "INVALID_URL": "Invalid website address",
    "UNSUPPORTED_SCHEME": "Invalid website address",
}
DECISION_EXPLANATIONS = {
    "READY_TO_CHECK": "Valid website ready to scan.",
    "SEARCH_ENGINE_PAGE": "Search engine result pages are excluded.",
    "MAPS_OR_DIRECTIONS": "Map and direction pages are excluded.",
    "ADVERTISEMENT_OR_TRACKING_REDIRECT": "Ad click and tracking redirect links are excluded.",
    "ACCOUNT_OR_AUTH_PAGE": "Account and authentication pages are excluded.",
    "SUPPORT_OR_HELP_PAGE": "Platform support and help documentation pages are excluded.",
    "PRIVACY_TERMS_OR_POLICY_PAGE": "Platform privacy and terms policy pages are excluded.",
    "NON_TARGET_PLATFORM_PAGE": "Platform service landing pages are excluded.",
}
NO_SUFFIX_EXPLANATION = (
    "Domain address must include a valid top-level domain (e.g., .com, .org)."
)
LOOKALIKE_EXPLANATION = (
    "This address is not an official Google domain and should be reviewed before scanning."
)
PUBLIC_IP_EXPLANATION = "Public literal IP address requires review before scanning."

# --- fixed values: host policy ---------------------------------------------------------------
BLOCKED_HOSTNAMES = (
    "localhost", "localhost.localdomain", "metadata", "metadata.google.internal",
)
BLOCKED_HOST_SUFFIXES = (".localhost", ".local", ".internal", ".lan", ".home")

# Special-purpose address blocks (IANA registries, as the standard `ipaddress` module reads them).
IPV4_PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
IPV4_PRIVATE_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")
IPV4_SHARED = ("100.64.0.0/10",)
IPV6_PRIVATE = (
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10",
)
IPV6_PRIVATE_EXCEPTIONS = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
)
IPV6_RESERVED = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3",
    "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9",
)

# --- fixed values: link discovery and ranking ------------------------------------------------
REJECTED_LINK_SCHEMES = (
    "mailto:", "tel:", "javascript:", "data:", "file:", "ftp:", "about:", "urn:", "sms:",
)
ASSET_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff", ".mp4",
    ".webm", ".avi", ".mov", ".mkv", ".flv", ".mp3", ".wav", ".ogg", ".m4a", ".zip", ".tar",
    ".gz", ".7z", ".rar", ".bz2", ".xz", ".pdf", ".exe", ".dmg", ".pkg", ".deb", ".rpm",
    ".apk", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".json", ".xml",
    ".css", ".js", ".woff", ".woff2", ".ttf", ".eot", ".otf",
)
RANKING_VERSION = "page-ranking-v1"
HOME_PATHS = ("", "/", "/index.html", "/index.htm", "/home")
# signal -> (weight, substrings that switch it on); the home-page signal looks at the path only
PAGE_SIGNALS = {
    "HOME_PAGE": (50, ()),
    "KEYWORD_CONTACT": (100, ("contact", "contacts", "contact-us", "get-in-touch", "reach-us")),
    "KEYWORD_TEAM": (
        90,
        ("team", "staff", "leadership", "people", "management", "executives", "founders",
         "board", "our-team"),
    ),
    "KEYWORD_ABOUT": (80, ("about", "about-us", "who-we-are", "company", "our-story")),
    "KEYWORD_LOCATIONS": (60, ("locations", "offices", "branches", "find-us")),
    "KEYWORD_SUPPORT": (40, ("support", "help", "help-center", "faq")),
    "KEYWORD_LEGAL": (30, ("legal", "imprint", "privacy", "terms")),
    "NEGATIVE_ARCHIVE": (-40, ("/page/", "/archive/", "/tag/", "/category/")),
    "NEGATIVE_SEARCH": (-50, ("search", "query")),
    "NEGATIVE_ACCOUNT": (-80, ("account", "profile", "my-account", "settings", "dashboard")),
    "NEGATIVE_LOGIN": (
        -100, ("login", "signin", "signup", "register", "auth", "sso", "password")),
    "NEGATIVE_ECOMMERCE": (-100, ("cart", "checkout", "basket", "bag", "store", "buy")),
}

# --- fixed values: e-mail extraction, validation, category -----------------------------------
TRIM_PUNCTUATION = ".,;:!?)]\"'"
SOURCE_PRIORITY = {"MAILTO": 3, "VISIBLE_TEXT": 2, "OBFUSCATED_TEXT": 1}
PLACEHOLDER_DOMAINS = (
    "example.com", "example.org", "example.net", "example.edu", "invalid", "localhost", "test",
    "local", "test.com", "test.org", "test.net", "sample.com", "yourdomain.com", "mysite.com",
)
NO_REPLY_LOCALS = (
    "noreply", "no-reply", "do-not-reply", "donotreply", "nobody", "bounce", "mailer-daemon",
    "null",
)
DUMMY_LOCALS = ("test", "testing", "dummy", "asdf", "qwerty", "foo", "bar")
ASSET_LIKE_LOCALS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js")
ROLE_LOCALS = (
    "info", "sales", "support", "contact", "office", "hello", "admin", "help", "billing",
    "jobs", "careers", "media", "press", "marketing", "privacy", "security", "legal",
    "webmaster", "postmaster", "team", "staff", "enquiries", "inquiries", "estimating",
    "estimates", "quote", "quotes", "hr",
)

# --- fixed values: primary selection ---------------------------------------------------------
SELECTION_VERSION = "primary-email-selection-v1"
FREE_PROVIDERS = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "yahoo.ca", "hotmail.com",
    "hotmail.co.uk", "outlook.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com",
    "mac.com", "proton.me", "protonmail.com", "gmx.com", "zoho.com", "yandex.com", "mail.com",
)
TOP_CONTACT_ROLES = (
    "contact", "info", "sales", "estimating", "estimates", "quote", "quotes", "office",
    "hello", "enquiries", "inquiries", "support",
)
RECRUITMENT_ROLES = ("jobs", "careers", "hr", "recruitment", "employment", "work")
UTILITY_ROLES = (
    "privacy", "legal", "security", "webmaster", "postmaster", "billing", "abuse", "admin",
    "help", "media", "press", "marketing", "team", "staff",
)
SOURCE_WEIGHTS = {"MAILTO": 300, "VISIBLE_TEXT": 200, "OBFUSCATED_TEXT": 100}

# --- fixed values: job state -----------------------------------------------------------------
JOB_STATUSES = (
    "DRAFT", "QUEUED", "RUNNING", "CANCELLING", "CANCELLED", "COMPLETED",
    "COMPLETED_WITH_ERRORS", "FAILED",
)
URL_STATUSES = (
    "INVALID", "PENDING", "QUEUED", "LEASED", "SCANNING", "RETRY_WAIT", "COMPLETED",
    "NO_EMAIL", "FAILED", "CANCELLED", "DUPLICATE",
)
CLASSIFICATIONS = ("ROLE_BASED", "PERSONAL_OR_NAMED", "NO_REPLY", "UNKNOWN")
VALIDATION_STATUSES = ("VALID", "UNVERIFIED", "INVALID")
SOURCE_TYPES = ("MANUAL", "CSV", "XLSX", "API")
ACTIVE_ANALYTICS_STATUSES = ("QUEUED", "RUNNING", "CANCELLING")
ACTIVE_JOB_STATUSES = ("DRAFT", "QUEUED", "RUNNING", "CANCELLING")
TERMINAL_JOB_STATUSES = ("CANCELLED", "COMPLETED", "COMPLETED_WITH_ERRORS", "FAILED")
ACTIVE_URL_STATUSES = ("PENDING", "QUEUED", "LEASED", "SCANNING", "RETRY_WAIT")
OPEN_URL_STATUSES = ("PENDING", "QUEUED", "SCANNING", "RETRY_WAIT")
TERMINAL_URL_STATUSES = ("COMPLETED", "NO_EMAIL", "FAILED", "CANCELLED")
LEGAL_TRANSITIONS = (
    ("DRAFT", "QUEUED"),
    ("QUEUED", "RUNNING"),
    ("QUEUED", "CANCELLED"),
    ("RUNNING", "CANCELLING"),
    ("RUNNING", "COMPLETED"),
    ("RUNNING", "COMPLETED_WITH_ERRORS"),
    ("RUNNING", "FAILED"),
    ("CANCELLING", "CANCELLED"),
)

# --- fixed values: outcomes and retries ------------------------------------------------------
RETRYABLE_HTTP_STATUSES = (408, 425, 429, 500, 502, 503, 504)
FETCH_FAILURE_CODES = {
    "DNS_RESOLUTION_FAILED": "DNS_RESOLUTION_FAILED",
    "UNSAFE_HOST": "UNSAFE_HOST",
    "TLS_VERIFICATION_FAILED": "TLS_VERIFICATION_FAILED",
    "TIMEOUT": "GENERIC_TIMEOUT",
    "TRANSPORT_ERROR": "TRANSPORT_ERROR",
    "HTTP_ERROR": "HTTP_ERROR",
    "UNSUPPORTED_CONTENT_TYPE": "UNSUPPORTED_CONTENT_TYPE",
    "RESPONSE_TOO_LARGE": "RESPONSE_TOO_LARGE",
    "OUT_OF_SCOPE_REDIRECT": "OUT_OF_SCOPE_REDIRECT",
}
# outcome of a fetch -> is a retry of the whole scan worthwhile (HTTP_ERROR depends on the status)
FETCH_RETRYABILITY = {
    "TIMEOUT": True,
    "TRANSPORT_ERROR": True,
    "DNS_RESOLUTION_FAILED": True,
    "UNSAFE_HOST": False,
    "INVALID_URL": False,
    "TLS_VERIFICATION_FAILED": False,
    "OUT_OF_SCOPE_REDIRECT": False,
    "RESPONSE_TOO_LARGE": False,
    "UNSUPPORTED_CONTENT_TYPE": False,
    "MAX_REDIRECTS_EXCEEDED": False,
}
# outcome of a page -> (error code, retryable) when the page record alone decides
PAGE_DECISIONS = {
    "ROBOTS_DISALLOWED": ("ROBOTS_BLOCKED", False),
    "ROBOTS_TEMPORARY_FAILURE": ("ROBOTS_FETCH_ERROR", True),
    "UNSAFE_HOST": ("UNSAFE_HOST", False),
    "RESPONSE_TOO_LARGE": ("RESPONSE_TOO_LARGE", False),
    "UNSUPPORTED_CONTENT_TYPE": ("UNSUPPORTED_CONTENT_TYPE", False),
}
FETCH_RETRY_REASONS = {
    "TIMEOUT": "TIMEOUT",
    "TRANSPORT_ERROR": "TRANSPORT_ERROR",
    "DNS_RESOLUTION_FAILED": "TRANSPORT_ERROR",
}
EXPORT_COLUMNS = (
    "scan_url_id", "target_url", "canonical_email", "email_domain", "classification",
    "is_role_based", "validation_status", "evidence_count", "first_found_at", "last_found_at",
)
