"""Results are only right if these are exactly so."""

# Decisions, page types and job states.
DONE, ESCALATE, ABORT, BACKOFF = "Done", "Escalate", "Abort", "Backoff"
CONTENT_RICH, LINK_RICH, APP_SHELL, MIXED = "content-rich", "link-rich", "app-shell", "mixed"
JOB_CREATED, JOB_ABORTED = "created", "aborted"
JOB_TIER_STATUS = {1: "tier1_complete", 2: "tier2_complete", 3: "tier3_complete", 4: "tier4_complete"}

# Limits.
MAX_BODY_BYTES = 10 * 1024 * 1024
MAX_TEXT_BYTES = 4000

# White space that callers trim (Unicode White_Space).
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Page signals, their selectors, phrases and default penalties.
PENALTIES = {
    "cf-challenge": 1.00,
    "captcha": 0.95,
    "noscript-message": 0.90,
    "empty-app-shell": 0.85,
    "low-text-density": 0.70,
    "tiny-body": 0.50,
}
CAPTCHA_SELECTOR = "[class*=recaptcha],[class*=hcaptcha],[class*=cf-turnstile],[data-sitekey]"
APP_SHELL_SELECTOR = "div#app, div#root, div#__next"
NOSCRIPT_PHRASES = (
    "enable javascript",
    "javascript required",
    "javascript is disabled",
    "javascript is required",
)

# Script patterns. White space is spelled out so that the vertical tab stays outside.
GLOBAL_NAMES = (
    "__NUXT__",
    "__REDUX_STATE__",
    "__INITIAL_STATE__",
    "__APP_STATE__",
    "__PRELOADED_STATE__",
    "__SERVER_DATA__",
    "__STORE__",
)
GLOBAL_MARK = "window.__"
# A declaration, and the end of an object: what lies between a declaration and the first end after it is the object.
GLOBAL_PATTERN = r"window\.{name}[\t\n\f\r ]*=[\t\n\f\r ]*(\{{[\s\S]*)"
INLINE_VAR_PATTERN = r"(?:var|const|let)[\t\n\f\r ]+[A-Z_][A-Z0-9_]*[\t\n\f\r ]*=[\t\n\f\r ]*(\{[\s\S]*)"
OBJECT_END_PATTERN = r"\}[\t\n\f\r ]*;"

# Names and selectors the extractors ask for.
META_NAMES = ("description", "author", "keywords", "robots")
RDFA_PREFIXES = ("schema:", "og:", "dc:", "dcterms:")
CONTAINER_SELECTOR = (
    '[class*="product"], [class*="listing"], [class*="item"], [class*="card"], [class*="offer"], '
    "[data-sku], [data-product-id], [data-price], [data-id]"
)
TOKEN_NAMES = (
    "csrf_token",
    "_token",
    "authenticity_token",
    "_csrf",
    "csrfmiddlewaretoken",
    "__requestverificationtoken",
)
HIDDEN_STYLE_SELECTOR = (
    '[style*="display:none" i], [style*="display: none" i], '
    '[style*="visibility:hidden" i], [style*="visibility: hidden" i]'
)
HIDDEN_CLASS_SELECTOR = '.hidden, .sr-only, [aria-hidden="true"]'
UTILITY_CLASSES = ("hidden", "sr-only", "visually-hidden")

# Walls on rendered pages, in the order in which they are tried.
COOKIE_WALLS = ("#onetrust-banner-sdk", ".fc-dialog-container", "#CybotCookiebotDialog", ".cmp-popup")
LOGIN_SEGMENTS = ("/login", "/signin", "/sign-in")
PASSWORD_SELECTOR = 'input[type="password"]'
CHALLENGE_WALLS = ("#cf-challenge-running", ".cf-error-type-1010")
CAPTCHA_WALLS = ("[class*=recaptcha]", "[class*=hcaptcha]", "[data-sitekey]")

# Hosts kept out of a request table.
BLOCK_DOMAINS = (
    "*google-analytics.com*",
    "*googletagmanager.com*",
    "*doubleclick.net*",
    "*facebook.com/tr*",
    "*hotjar.com*",
)

# Fixed value: the prompt of the text fallback.
PROMPT = """You are a structured data extractor. Given the following webpage text, extract these fields if present:
- title: the main title of the page/article/product
- description: a brief description or summary
- price: price if this is a product page (include currency symbol)
- author: author name if this is an article
- date: publication or last updated date

Respond with ONLY a JSON object containing the fields you found. Omit fields that are not present.
Example: {"title": "...", "description": "...", "price": "$9.99"}

Webpage text:
%s"""
