"""Values that must equal the semantics that are asked for, in one place."""

# Query parameters that a normalised URL loses.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "fbclid", "gclid"]

# Path endings of resources that are not pages.
SKIP_EXTENSIONS = """
.pdf .jpg .jpeg .png .gif .svg .ico .webp .avif .css .js .mjs .cjs .ts .tsx .jsx .woff .woff2 .ttf .eot .otf
.mp4 .mp3 .wav .ogg .webm .avi .mov .zip .tar .gz .rar .7z .exe .dmg .pkg .deb .rpm .json .xml .yaml .yml .toml
.doc .docx .xls .xlsx .ppt .pptx
""".split()

# Language codes (ISO 639-1).
LANGUAGES = """
en de fr es it pt nl pl ru ja ko zh ar hi tr vi th id ms sv no da fi cs el he hu ro sk uk bg hr lt lv et sl
bn ta te mr gu kn ml pa ur
km lo ne si tl mn fa ps
sq mk sr bs is mt cy ga eu gl
sw am af ha yo ig zu
az uz kk ka hy tg
""".split()

# Country codes (ISO 3166-1 alpha-2).
COUNTRIES = """
us gb uk ca au nz ie de at ch fr be es it pt nl pl ru se no dk fi cz gr hu ro sk ua bg hr rs si lt lv ee
jp kr cn tw hk sg my th vn ph mm kh la np lk bd pk
in ae sa il eg ma dz tn lb jo kw qa bh om iq ir tr
za ng ke gh tz ug et sn ci
mx ar br co cl pe ec ve bo py uy cr pa gt hn ni cu do pr jm
""".split()

# Codes that are words where they stand inside a path.
NOT_LOCALES = "us uk my in at be to do go so no id am is it me or as if an on up la ha pa om".split()

# Query parameters that name a locale, in order of preference.
LOCALE_PARAMS = ["lang", "locale", "hl", "language"]

# Hosts that need a browser.
PROTECTED_HOSTS = "linkedin.com instagram.com facebook.com twitter.com x.com tiktok.com indeed.com glassdoor.com zillow.com yelp.com".split()

# Index pages, for which a URL is not a specific page.
INDEX_PAGE = r"(?i)^/(index\.(html?|php|aspx?)|default\.(html?|aspx?))$"

# Patterns of block pages.
CLOUDFLARE = [r"(?i)Checking your browser", r"(?i)cf-browser-verification", r"(?i)cloudflare", r"_cf_chl_opt", r"(?i)challenge-platform", r"(?i)Just a moment\.\.\.", r"(?i)ray id:", r"(?i)cf-turnstile"]
DATADOME = [r"(?i)datadome", r"dd\.js", r"captcha-delivery\.com", r"geo\.captcha-delivery\.com"]
PERIMETERX = [r"(?i)perimeterx", r"(?i)px-captcha", r"_pxhd", r"(?i)human challenge"]
AKAMAI = [r"(?i)akamai", r"ak_bmsc", r"_abck"]
GENERIC_BLOCK = [
    r"(?i)access denied",
    r"(?i)please verify you are human",
    r"(?i)enable javascript",
    r"(?i)browser.*not supported",
    r"(?i)automated access",
    r"(?i)bot detected",
    r"(?i)please complete the security check",
    r"(?i)unusual traffic",
    r"(?i)blocked",
    r"(?i)forbidden",
    r"(?i)not allowed",
]
CAPTCHA = [r"(?i)recaptcha", r"(?i)hcaptcha", r"g-recaptcha", r"h-captcha", r"(?i)captcha", r"(?i)turnstile"]

# Which files of a source tree are read.
CODE_EXTENSIONS = """
.js .jsx .ts .tsx .mjs .cjs .py .pyi .rs .go .java .kt .kts .c .h .cpp .hpp .cc .cxx .cs .rb .php .swift
.sh .bash .zsh .html .css .scss .sass .less .vue .svelte .json .yaml .yml .toml .xml .ini .env.example
.md .mdx .rst .txt .adoc .sql .graphql .gql .sol
""".split()
SKIP_DIRS = """
node_modules .git .svn .hg vendor target dist build out .next .nuxt __pycache__ .pytest_cache .mypy_cache venv .venv env
.tox coverage .coverage .nyc_output logs tmp .cache .parcel-cache .turbo
""".split()
SKIP_FILES = "package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock Gemfile.lock poetry.lock composer.lock".split()
MAX_FILE_BYTES = 500 * 1024
LANGUAGE_OF_EXTENSION = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".rs": "rust", ".go": "go",
    ".java": "java", ".kt": "kotlin", ".c": "c", ".cpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".sh": "shell", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".sql": "sql", ".html": "html", ".css": "css",
    ".vue": "vue", ".svelte": "svelte",
}

# Elements that are removed before extraction.
REMOVE_TAGS = "script style noscript iframe svg canvas nav header footer aside".split()
REMOVE_ROLES = "banner navigation contentinfo complementary menu menubar".split()
REMOVE_CLASSES = """
nav navbar navigation header footer sidebar menu top-bar bottom-bar site-header site-footer page-header page-footer masthead
ad ads advertisement advert sponsored tracking analytics
popup modal overlay lightbox dialog cookie-banner cookie-consent cookie-notice gdpr consent-banner
social-share share-buttons share-links social-links follow-us social-icons
comments comment-section comment-form discuss discussion
related-posts related-articles recommended suggestions more-from you-may-like also-read
newsletter subscribe subscription signup-form email-signup mailing-list
breadcrumb breadcrumbs pagination pager
author-bio author-box about-author
hidden visually-hidden screen-reader-text sr-only
print-only no-screen
""".split()
REMOVE_CLASS_PARTS = ["ad-", "ads-"]
REMOVE_IDS = ["comments", "disqus"]
REMOVE_ID_PARTS = ["google_ads"]
KEEP_EMPTY = "br hr img input meta link area base col embed source track wbr".split()
KEEP_DATA = ["data-language", "data-lang"]

# Where the main content is looked for, in order: (kind, value).
MAIN_CONTENT = [
    ("tag", "main"), ("tag", "article"), ("role", "main"), ("id", "main-content"), ("id", "content"), ("class", "main-content"),
    ("class", "content"), ("class", "post-content"), ("class", "article-content"), ("class", "entry-content"), ("class", "post-body"), ("class", "article-body"),
]
REFERENCES = [
    ("id", "references"), ("class", "references"), ("class", "references-section"), ("class*", "reference"), ("id", "bibliography"),
    ("class", "bibliography"), ("id*", "references"),
]

# Marks of the language of a code block, the first language that fits: something of each list, and of the last.
# (JSON must also be JSON.)
CODE_MARKS = [
    ("jsx", [["import"], ["React", "<"]], ["React", "/>"]),
    ("typescript", [[": "]], ["interface", "type ", "as ", ": string", ": number"]),
    ("javascript", [], ["import ", "export ", "=>", "const ", "let "]),
    ("json", [], [":", ","]),
    ("bash", [], ["#!/bin/", "npm ", "yarn ", "bun ", "$ "]),
]
CODE_DEFAULT = "javascript"

# What an error message is told as: the first row of which the message holds a mark.
ERROR_MESSAGES = [
    (["dimension mismatch"], "Vector dimension mismatch. The file was created with a different embedding model."),
    (["OPENAI_API_KEY"], "OpenAI API key required. Set OPENAI_API_KEY environment variable or use --api-key flag"),
    (["ENOENT"], "File not found: "),
    (["EACCES"], "Permission denied. Check file permissions."),
    (["ENOSPC"], "Disk full. Free up space and try again."),
    (["fetch failed", "ETIMEDOUT"], "Network error. Check your internet connection."),
    (["rate limit", "429"], "Rate limited. Wait a moment and try again."),
]
UNKNOWN_ERROR, UNKNOWN_FILE = "Unknown error", "unknown"

# Where a preview looks for sitemaps, in order: news, whose dates count, then regular ones.
NEWS_SITEMAPS = ["/sitemap/news.xml", "/news-sitemap.xml", "/sitemap-news.xml", "/sitemaps/news.xml"]
REGULAR_SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml"]

# Progress milestones and the marker of a cut text.
MILESTONES = [10, 25, 50, 75, 100, 150, 200, 300, 500]
TRUNCATED = "\n\n[Content truncated...]"

# What counts as white space in the semantics that are asked for.
WHITE_SPACE = "\\t\\n\\x0B\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
