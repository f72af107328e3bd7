"""Fixed values.

Everything in this file is a value that has to be the same for results to match:
word lists, lookup tables, patterns, thresholds, templates. They are stated
plainly and kept together so that no operator hides one.
"""

# --- fixed values: enumerations ------------------------------------------------
FAMILIES = ("academia", "industry", "community", "meta")
TIERS = ("quiet_day", "minor", "notable", "breakthrough")  # ascending rank
SIGNALS = ("up", "down", "click", "dwell", "nl_instruction")
TARGET_KINDS = ("item", "story", "digest_section", "digest")
DIGEST_KINDS = ("daily", "weekly")

# --- fixed values: windows and caps --------------------------------------------
NEWS_LOOKBACK_HOURS = 36
ACADEMIA_LOOKBACK_HOURS = 96
WEEKLY_LOOKBACK_DAYS = 8
FEEDBACK_LOOKBACK_DAYS = 30
PER_SOURCE_CAP = 20
PREVIEW_PER_SOURCE_CAP = 18
TOP_STORIES_CAP = 6
BRIEF_CAP = 6
GROUNDING_TITLES_CAP = 8
SOURCE_ITEMS_CAP = 5
SOURCE_CHARS = 600
SNIPPET_CHARS = 240
WEEKLY_BLOCKS_CAP = 20
EMBED_LEAD_CHARS = 1200
HTML_CHARS = 4000
READER_MIN_CHARS = 280
READER_MAX_CHARS = 8000
MIN_SOURCE_CHARS = 200
CONDENSED_PER_SECTION = 3
CONDENSED_CHARS = 3500
WHY_LIMIT = 400
TAKEAWAY_LIMITS = {"minor": 320, "notable": 700, "breakthrough": 1600}
CALLBACK_CHARS = 64
SIGNATURE_CHARS = 32

# --- fixed values: scoring ------------------------------------------------------
FAMILY_AUTHORITY = {"academia": 0.9, "industry": 0.8, "meta": 0.7, "community": 0.6}
SOURCE_AUTHORITY = {
    "arxiv": 0.85,
    "openreview": 0.9,
    "semantic_scholar": 0.85,
    "hf_papers": 0.8,
    "hn": 0.65,
    "reddit": 0.55,
}
UNKNOWN_AUTHORITY = 0.5
VIRAL_ENGAGEMENT = 2500.0
ENGAGEMENT_POWER = 0.6
UNCORROBORATED_FACTOR = 0.5
MENTION_SATURATION = 4.0
MENTION_WEIGHT = 0.85
RECENCY_HALF_LIFE_DAYS = 2.0
FEEDBACK_HALF_LIFE_DAYS = 14.0
ANNOUNCEMENT_FLOOR = 0.42
MUTE_PENALTY = 0.5
SIGNAL_WEIGHT = {"up": 1.0, "down": -1.0, "click": 0.25, "dwell": 0.15}
DWELL_CAP_SECONDS = 120.0
FEEDBACK_BLEND = 0.5
DEDUP_COSINE = 0.90
STORY_COSINE = 0.86
LEAD_COSINE = 0.84
PAPER_TITLE_OVERLAP = 0.15
MIN_POINTS = 20
MIN_FORUM_SCORE = 5
REPLAY_MIN_POINTS = 40
REPLAY_LIMIT = 60
REPLAY_SAMPLE_HOURS = 72
PAPER_SOURCES = ("arxiv", "hf_papers")

RANKING = {"alpha": 0.5, "beta": 0.4, "gamma": 0.1}
TIER_THRESHOLDS = {
    "breakthrough_min_score": 0.72,
    "breakthrough_importance_override": 0.55,
    "notable_min_score": 0.40,
    "minor_min_score": 0.30,
    "quiet_day_top_score": 0.40,
    "quiet_day_min_importance": 0.32,
    "notable_day_min_importance": 0.32,
}
TIER_CANDIDATES = {
    "current": {},
    "stricter_breakthrough": {
        "breakthrough_importance_override": 0.62,
        "breakthrough_min_score": 0.78,
    },
    "tighter_notable": {"notable_min_score": 0.60, "minor_min_score": 0.34},
    "looser_quiet": {"quiet_day_min_importance": 0.34},
}
RUBRIC_WEIGHTS = {
    "insight": 0.25,
    "accuracy": 0.25,
    "narrative": 0.20,
    "personal_fit": 0.20,
    "honesty": 0.10,
}
RUBRIC_MIN, RUBRIC_MAX = 1.0, 5.0
QUIET_VIOLATION_CAP = 2.0
COVERAGE_FLOOR = 0.7
COVERAGE_TOP_K = 10
MIN_EDITORIAL_TOTAL = 3.0

# --- fixed values: word lists ----------------------------------------------------
RELEVANCE_KEYWORDS = (
    "ai", "llm", "language model", "gpt", "claude", "gemini", "deepseek", "qwen",
    "mistral", "llama", "transformer", "neural", "machine learning", "deep learning",
    "rlhf", "rl ", "reinforcement learning", "diffusion", "embedding", "fine-tun",
    "agent", "openai", "anthropic", "deepmind", "hugging face", "huggingface",
    "pytorch", "tensor", "inference", "quantization", "moe", "mixture of experts",
    "rag", "multimodal", "vision-language", "nlp", "arxiv",
)
TITLE_STOP_WORDS = (
    "the", "and", "for", "with", "via", "from", "this", "that", "are", "its",
)
SELF_PROMO_PREFIXES = ("show hn:", "tell hn:", "ask hn:")
QUIET_MARKERS = (
    "quiet day", "quiet week", "nothing major shipped", "nothing major",
    "no important paper", "no major release", "no breakthrough", "slow day",
    "slow news day", "uneventful",
)
INFLATION_MARKERS = (
    "revolutionary", "game-chang", "groundbreaking", "breakthrough", "massive leap",
    "paradigm shift", "stunning", "unprecedented",
)
AGGREGATOR_SOURCES = ("smol.ai",)
ARXIV_CATEGORIES = ("cs.CL", "cs.LG", "cs.AI")

# --- fixed values: patterns ------------------------------------------------------
AGGREGATOR_URL = r"(?i)latent\.space/p/ainews-"
RELEASE_TITLE = (
    r"(?i)\b(unveils?|introduc\w+|releas\w+|launch\w+|announc\w+|ships?|debuts?|"
    r"open[- ]?sourc\w+|presents?|now available|rolls?\s+out|rolling\s+out)\b"
)
DEAL_TITLE = (
    r"(?i)\braises?\s+\$|\bacquires?\b|\bacquisition\s+of\b|\bpartners?\s+with\b"
    r"|\bsigns?\s+(?:a\s+|an\s+)?deal\b|\binvests?\s+\$"
)
ANNOUNCE_TITLE = (
    r"(?i)\b(unveils?|introduc\w+|releas\w+|launch\w+|announc\w+|ships?|debuts?|"
    r"available|open[- ]?sourc\w+|presents?)\b"
)
ESSAY_TITLE = (
    r"(?i)^\s*(how |why |what |when |the case for|thoughts on|reflections|is |are |"
    r"should |has )"
)
RECAP_TITLE = (
    r"(?i)\b(?:not much happened|nothing much happened|quiet day|quiet week(?:end)?"
    r"|slow news|weekly (?:recap|roundup)|week in review"
    r"|top ai (?:news|stories)|news roundup|daily (?:digest|recap))\b"
    r"|\bainews\s*[:—\-]"
)
ANECDOTE_TITLE = (
    r"(?i)\b(my (resume|cv|mri|ct scan|x[- ]?ray|tumou?r|cancer|diagnosis|blood ?work|"
    r"salary|landlord|boss|professor|grade|exam)|second opinion)\b"
)
SIGNIFICANT_NUMBER = (
    r"(?i)\$\s*\d[\d,]*(?:\.\d+)?\s*(?:k|m|bn?|billion|million|trillion|b|t)?"
    r"|\d[\d,]*(?:\.\d+)?\s*(?:%|×|x\b|k\b|bn?\b|billion|million|trillion|"
    r"tokens?|params?|pts?|bps|ms|gb|tb|flops?|b\b|t\b)"
    r"|\d[\d,]*\.\d+"
)
NUMBER_CORE = r"\d[\d,]*(?:\.\d+)?"
PAPER_ID = r"(\d{4}\.\d{4,5})"
TEXT_UPVOTES = r"(?i)(\d+)\s*(?:upvote|👍|likes?)"

# --- fixed values: labels and templates ------------------------------------------
LINK_LABELS = (
    ("arxiv.org", "arXiv"),
    ("huggingface.co", "HF"),
    ("openreview.net", "OpenReview"),
    ("reddit.com", "Reddit"),
    ("news.ycombinator.com", "HN"),
    ("github.com", "GitHub"),
)
HTML_ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
)
TIER_LABELS = {
    "breakthrough": "BREAKTHROUGH",
    "notable": "NOTABLE",
    "minor": "MINOR",
    "quiet_day": "QUIET",
}
FAMILY_EMOJI = {"academia": "🎓", "industry": "🏭", "community": "💬", "meta": "🗞️"}
FAMILY_HEADINGS = {
    "academia": "Academia",
    "industry": "Industry",
    "community": "Community",
    "meta": "Meta",
}
TOP_HEADING = "⚡ Top Stories"
QUIET_TLDR = "Quiet day — nothing major shipped."
QUIET_TLDR_BRIEF = "Quiet day — nothing major shipped, but a few things worth a glance."
QUIET_TAKEAWAY = "Minor item; nothing major here."
DEFAULT_PROFILE_TEXT = "Artificial intelligence research and engineering."
FEED_CATALOGUE = (
    ("openai", "https://openai.com/news/rss.xml", "industry"),
    ("deepmind", "https://deepmind.google/blog/rss.xml", "industry"),
    ("google-ai", "https://blog.google/technology/ai/rss/", "industry"),
    ("mistral", "https://mistral.ai/rss.xml", "industry"),
    ("qwen", "https://qwenlm.github.io/blog/index.xml", "industry"),
    ("huggingface", "https://huggingface.co/blog/feed.xml", "industry"),
    ("nvidia-ai", "https://blogs.nvidia.com/blog/category/deep-learning/feed/", "industry"),
    ("together", "https://www.together.ai/blog/rss.xml", "industry"),
    ("techcrunch-ai", "https://techcrunch.com/category/artificial-intelligence/feed/", "industry"),
    ("venturebeat-ai", "https://venturebeat.com/category/ai/feed/", "industry"),
    ("theverge-ai", "https://www.theverge.com/rss/ai-artificial-intelligence/index.xml", "industry"),
    ("latent-space", "https://www.latent.space/feed", "meta"),
    ("import-ai", "https://importai.substack.com/feed", "meta"),
    ("interconnects", "https://www.interconnects.ai/feed", "meta"),
)

# Whitespace as Python's str.strip and \s see it; valid in Java and RE2 alike.
WS = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters as a list, for trimming without a regular expression.
WS_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
