"""Fixed values that results depend on: names, words and endings, each list in one place."""

#: Endings of what is fetched as an asset, whoever asks.
ASSET_ENDINGS = "jpg jpeg png gif webp avif svg ico bmp tif tiff css js mjs cjs map woff woff2 ttf otf eot mp4 webm ogg ogv mp3 wav m4a flac pdf zip gz".split()

#: Elements whose text is not shown, furniture of a page, and elements that begin a block.
SILENT_ELEMENTS = "script style noscript template svg head iframe object select".split()
FURNITURE_ELEMENTS = "nav aside footer form".split()
BLOCK_ELEMENTS = "p div section article main h1 h2 h3 h4 h5 h6 li tr td th blockquote pre br hr figcaption dd dt ul ol table header footer nav aside".split()
#: What a block is, by the element that began it (else a paragraph).
BLOCK_KINDS = {"h1": "h1", "h2": "h2", "h3": "h3", "h4": "h3", "h5": "h3", "h6": "h3", "li": "li", "dd": "li", "dt": "li", "blockquote": "quote", "pre": "pre", "figcaption": "caption"}
#: Words in a class, id or role that mark furniture, and those that mark the page's own text in spite of it.
FURNITURE_WORDS = (
    "navbar nav navigation menu sidebar side footer masthead header comment comments share social related breadcrumb breadcrumbs pagination pager widget-area "
    "banner cookie skip-link screen-reader crosscol attribution site-info post-footer entry-footer entry-meta blog-pager tabs toolbar subscribe newsletter advert "
    "ad ads promo popup modal"
).split()
CONTENT_WORDS = "post-body post-content post-header post-title entry-content entry-body entry-header entry-title article-body article-header content".split()

#: Hosts by what they are for, and words in a host's name that say so.
ANALYTICS_HOSTS = (
    "google-analytics.com googletagmanager.com analytics.google.com doubleclick.net googlesyndication.com googleadservices.com scorecardresearch.com quantserve.com "
    "hotjar.com mixpanel.com segment.io segment.com amplitude.com matomo.cloud statcounter.com clarity.ms newrelic.com sentry.io facebook.net connect.facebook.net "
    "adservice.google.com amazon-adsystem.com criteo.com taboola.com outbrain.com pubmatic.com rubiconproject.com"
).split()
SOCIAL_HOSTS = "facebook.com twitter.com x.com platform.twitter.com instagram.com pinterest.com linkedin.com reddit.com tumblr.com addthis.com sharethis.com www.blogger.com".split()
COMMENT_HOSTS = "disqus.com disquscdn.com commento.io hyvor.com utteranc.es".split()
FONT_HOSTS = "fonts.gstatic.com fonts.googleapis.com use.typekit.net fontawesome.com".split()
IMAGE_WORDS = "img image images photo photos media static cdn bp".split()
ANALYTICS_WORDS = "analytics telemetry tracking metrics pixel beacon".split()

#: Names that some file systems keep for devices, characters that shares can't carry, and the longest name.
RESERVED_NAMES = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
NOT_IN_NAMES = '<>:"/\\|?*' + "".join(map(chr, range(32)))
LONGEST_NAME = 96

#: Query parameters that say where a visitor came from, or which variant of a page was asked for.
TRACKING = "fbclid gclid dclid msclkid yclid igshid mc_cid mc_eid _ga _gl m".split()
#: Parts of a path that mark a feed of comments.
COMMENT_MARKERS = ["/comments/", "/comments", "comments/feed", "/feeds/comments"]
#: Types of feeds, and attributes that hold what a page loads later.
FEED_TYPES = ["application/atom+xml", "application/rss+xml", "application/feed+json"]
LAZY_ATTRIBUTES = "data-src data-srcset data-original data-lazy-src data-bg".split()

#: Parts of the address of a gate, and what a gate says (patterns, whatever their case).
GATE_MARKERS = ["/interstitial/", "/content-warning", "blogger.com/blogin.g", "/b/blogger-warning"]
GATE_PHRASES = [
    r"I understand and wish to continue",
    r"content\s+warning",
    r"blog\s+contains\s+content\s+.{0,40}adult",
    r"viewer\s+discretion",
    r"you\s+must\s+be\s+(?:18|21|of\s+legal\s+age)",
]

#: How platforms give themselves away: as a word in the generator, by their domains, by their markup (patterns).
GENERATOR_WORDS = "blogger wordpress ghost squarespace mediawiki discourse".split()
PLATFORM_DOMAINS = {
    "substack": ["substack.com"],
    "wordpress": ["wordpress.com"],
    "ghost": ["ghost.io"],
    "squarespace": ["squarespace.com"],
    "mediawiki": "wikipedia.org wikimedia.org wiktionary.org wikibooks.org wikinews.org wikiquote.org wikisource.org wikiversity.org wikivoyage.org fandom.com miraheze.org wiki.gg".split(),
}
PLATFORM_MARKUP = {
    "blogger": r"blogger\.com/(?:static|dyn-css)|blogblog\.com|_WidgetManager",
    "wordpress": r"/wp-content/|/wp-includes/",
    "ghost": r"ghost-sdk|/ghost/api/",
    "substack": r"substackcdn\.com|substack\.com/api",
    "squarespace": r"SQUARESPACE_CONTEXT|squarespace-cdn\.com|squarespace\.com/",
    "mediawiki": r"wgPageName|mw-content-text|/load\.php\?",
    "discourse": r"discourse-cdn\.com|/message-bus/|discourse_theme_id",
}

#: What is said of a site's state; ``{}`` is the answer's code or the address it leads to.
STATE_SENTENCES = {
    "gone": "The live site returns {}. These pages are now only in your archive.",
    "moved": "The live site now redirects to {}. Add it as a second seed to keep archiving it.",
    "blocked": "The live site answered {}. That is about us, not about whether it exists — an access profile may be needed.",
    "unreachable": "The live site could not be reached. That is as likely to be this end as theirs.",
    "live": "The live site answers normally.",
}
