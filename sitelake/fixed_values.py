"""Lists, patterns and formats that decide results and are therefore stated as they are."""

# --- crawling -------------------------------------------------------------------------------------
# Paths starting with one of these are never captured (plain prefixes, case-sensitive).
DENY_PREFIXES = (
    "/wp-admin",
    "/wp-login.php",
    "/wp-json",
    "/xmlrpc.php",
    "/wp-cron.php",
    "/cart",
    "/checkout",
    "/my-account",
)
# Start paths of every site.
HOME_SEEDS = (
    "/",
    "/robots.txt",
    "/ads.txt",
    "/sitemap.xml",
    "/sitemap_index.xml",
    "/sitemap-index.xml",
    "/wp-sitemap.xml",
    "/wp-sitemap.xsl",
    "/wp-sitemap-index.xsl",
)
FEED_PATH = r"(?i)/(feed|trackback)(/|$)"
ASSET_PATH = r"(?i)\.[a-z0-9]{2,5}$"
CRAWL_SKIPPED_SCHEMES = r"(?i)^(mailto:|tel:|javascript:|data:|sms:|ftp:)"
EXPORT_SKIPPED_SCHEMES = r"(?i)^(data:|mailto:|tel:|javascript:)"
AUDIT_SKIPPED_SCHEMES = r"(?i)^(https?://|mailto:|tel:|data:|javascript:|//)"
FAILURES_SHOWN = 20

# --- link patterns --------------------------------------------------------------------------------
LINK_ATTRIBUTE = r"""(?i)(?:href|src|poster|data-src|data-lazy-src)\s*=\s*["']([^"']+)["']"""
SRCSET_ATTRIBUTE = r"""(?i)(?:srcset|data-srcset|data-lazy-srcset)\s*=\s*["']([^"']+)["']"""
META_IMAGE = r"""(?i)content\s*=\s*["'](https?://[^"']+\.(?:png|jpe?g|webp|gif|svg|ico))["']"""
CSS_URL = r"""(?i)url\(\s*['"]?([^'")\s]+)['"]?\s*\)"""
CSS_IMPORT = r"""(?i)@import\s+["']([^"']+)["']"""
HREF_ATTRIBUTE = r"""(?i)href\s*=\s*["']([^"']+)["']"""
HREFLANG_TAG = r"""(?i)<link[^>]+hreflang\s*=\s*["'][^"']+["'][^>]*>"""

# --- sitemaps -------------------------------------------------------------------------------------
SITEMAP_HEAD = 2048
SITEMAP_ROOTS = ("<sitemapindex", "<urlset")
SITEMAP_LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
SITEMAP_MEDIA_LOC = r"(?i)<(?:image|video):loc>\s*([^<\s]+)\s*</(?:image|video):loc>"
SITEMAP_ALTERNATE = r"""(?i)<xhtml:link[^>]+href\s*=\s*["']([^"']+)["']"""
SITEMAP_STYLESHEET = r"""(?i)<\?xml-stylesheet[^>]*href\s*=\s*["']([^"']+)["']"""
SITEMAP_FEED_URL = r"(?is)<url>\s*<loc>[^<]*/feed/(?:[^<]*)?</loc>.*?</url>"
SITEMAP_FEED_CHILD = r"(?is)<sitemap>\s*<loc>[^<]*/feed/(?:[^<]*)?</loc>.*?</sitemap>"

# --- files ----------------------------------------------------------------------------------------
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")
TEXT_EXTENSIONS = ("html", "htm", "css", "json", "xml", "txt", "md")
PRUNED_FOLDERS = ("feed", "wp-json")
HOME_PAGE = "index.html"
NOT_FOUND_FOLDER = "404_not_found"
NOT_FOUND_PAGE = "404.html"
PRESERVED_FILES = ("README.md", ".gitignore", "CNAME")
ALWAYS_PRESERVED = ".git"
FILE_MODE = "100644"
FOLDER_MODE = "40000"
ROBOTS_HEADER = ("User-agent: *", "Disallow:")
ADS_TXT_ACCOUNT = "f08c47fec0942fa0"
EXPORTS_KEPT = 2
EXPORTS_KEPT_LEAST, EXPORTS_KEPT_MOST = 1, 10
LOG_LINES = 60
LOG_LINES_STATUS = 80
LANGUAGE_MIN_LINKS = 2
LANGUAGE_SLUG = r"^[a-z]{2}(?:-[a-z]{2})?$"

# --- cleaning -------------------------------------------------------------------------------------
SCRIPT_ALLOWLIST = ("fuse.js", "fuse-js", "sfs-", "new Fuse(")
INLINE_CSS_MAX_BYTES = 15360
FONT_FACE = r"(?i)@font-face\s*\{[^}]*\}"
CSS_CHARSET = r"(?i)@charset[^;]*;"
CSS_URL_PARTS = r"""(?i)(url\(\s*["']?)([^"')\s]+)(["']?\s*\))"""
CSS_ROOTED_URL = r"(?i)^(data:|https?:|//|/|#)"
IMAGE_EXTENSION_AT_END = r"(?i)\.(png|jpe?g)$"
# The image endings that are renamed, as the oracle's engine writes them: it knows no look-ahead, so the sign that ends the name is kept.
ORACLE_IMAGE_END = r"""(?i)[.](png|jpe?g)(["'),?#<>]|\n?\z)"""
FONT_ORIGINS = ("https://fonts.googleapis.com", "https://fonts.gstatic.com")
ANALYTICS_LOADER = "https://www.googletagmanager.com/gtag/js?id="
ANALYTICS_MARK = "googletagmanager.com/gtag/js"
ADS_LOADER = "https://pagead2.googlesyndication.com/pagead/js/adsbygoogle.js?client="
ADS_MARK = "adsbygoogle.js"
UPGRADE_POLICY = (
    '<meta http-equiv="Content-Security-Policy" content="upgrade-insecure-requests">'
)
LAZY_SRC = ("data-src", "data-lazy-src")
LAZY_SRCSET = ("data-srcset", "data-lazy-srcset")
