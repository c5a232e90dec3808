"""Fixed values.

Names, labels, word lists, limits and formats that results depend on. They are
data, not logic: every operator that needs one reads it from here.
"""

# --- Fixed values: ingest ------------------------------------------------------
TIMESTAMP_COLUMNS = ("timestamp", "created_utc", "created_at")
EPOCH_COLUMN = "created_utc"
TEXT_COLUMNS = ("selftext", "title")
DEFAULT_SUBREDDIT = "unknown"
DEFAULT_SCORE = 0
DEFAULT_COMMENTS = 0
DEFAULT_DOMAIN = "self.reddit"
DEFAULT_UPVOTE_RATIO = 1.0
DEFAULT_URL = "#"
TITLE_LENGTH = 80

# --- Fixed values: embedding job -----------------------------------------------
NO_CONTENT = "[NO_CONTENT]"
MAX_TOKENS = 7000

# --- Fixed values: search and rankings -----------------------------------------
DEFAULT_TOP_K = 50
VIRAL_SCORE = 100
TOP_SUBREDDITS = 10
TOP_AUTHORS = 50
TOP_IMAGES = 6
UPVOTE_RANGE = (0.5, 1.0)

# --- Fixed values: sentiment ---------------------------------------------------
POSITIVE_ABOVE = 0.05
NEGATIVE_BELOW = -0.05
SENTIMENT_LABELS = ("positive", "negative", "neutral")
SENTIMENT_DISPLAY = {
    "positive": "🟢 Positive",
    "negative": "🔴 Negative",
    "neutral": "⚪ Neutral",
}
# Constants of the published valence rules.
NORMALISATION_ALPHA = 15.0
CAPITALS_BOOST = 0.733
BOOST = 0.293
NEGATION_FACTOR = -0.74
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
EXCLAMATION_BOOST = 0.292
EXCLAMATION_MAX = 4
QUESTION_BOOST = 0.18
QUESTION_MANY = 3
QUESTION_MAX = 0.96
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Degree words, negations and phrases of the public VADER sentiment library (MIT licence).
INTENSIFIERS = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply "
    "effing enormous enormously entirely especially exceptional exceptionally extreme "
    "extremely fabulously flipping flippin frackin fracking fricking frickin frigging friggin "
    "fully fuckin fucking fuggin fugging greatly hella highly hugely incredible incredibly "
    "intensely major majorly more most particularly purely quite really remarkably so "
    "substantially thoroughly total totally tremendous tremendously uber unbelievably "
    "unusually utter utterly very"
).split()
DAMPENERS = [
    *(
        "almost barely hardly kinda kindof kind-of less little marginal marginally occasional "
        "occasionally partly scarce scarcely slight slightly somewhat sorta sortof sort-of"
    ).split(),
    "just enough",
    "kind of",
    "sort of",
]
NEGATIONS = (
    "aint ain't arent aren't cannot cant can't couldnt couldn't darent daren't despite didnt "
    "didn't doesnt doesn't dont don't hadnt hadn't hasnt hasn't havent haven't isnt isn't "
    "mightnt mightn't mustnt mustn't neednt needn't neither never none nope nor not nothing "
    "nowhere oughtnt oughtn't rarely seldom shant shan't shouldnt shouldn't uhuh uh-uh wasnt "
    "wasn't werent weren't without wont won't wouldnt wouldn't"
).split()
IDIOMS = {
    "the shit": 3.0,
    "the bomb": 3.0,
    "bad ass": 1.5,
    "badass": 1.5,
    "bus stop": 0.0,
    "yeah right": -2.0,
    "kiss of death": -1.5,
    "to die for": 3.0,
    "beating heart": 3.1,
    "broken heart": -2.9,
}
RAISED_AFTER_NEVER = ("so", "this")
NEVER_SO_FACTOR = 1.25
NEGATION_CONTRACTION = "n't"
CONTRAST_WORD = "but"

# --- Fixed values: source and media classes ------------------------------------
SELF_PREFIX = "self."
SELF_MARKS = ("reddit.com",)
CATEGORY_SELF = "Original Discussion"
CATEGORY_MARKS = (
    ("Image/Media", ("v.redd.it", "i.redd.it", "imgur", "giphy", "gfycat")),
    ("Video", ("youtube", "youtu.be", "tiktok", "twitch", "vimeo")),
    ("Social Media", ("twitter", "x.com", "instagram", "facebook", "linkedin")),
)
CATEGORY_OTHER = "External Link / News"
MEDIA_MARKS = (
    ("Image", (".jpg", ".png", ".gif", "i.redd.it", "imgur.com")),
    ("Video", ("youtube", "youtu.be", "v.redd.it", "twitch", "tiktok")),
)
MEDIA_TEXT = "Text/Discussion"
MEDIA_TEXT_MARKS = ("reddit.com", "comments")
MEDIA_OTHER = "Link/Article"

# --- Fixed values: context links -----------------------------------------------
NEWS_SEARCH_URL = "https://www.google.com/search?q=%s&tbs=cdr:1,cd_min:%s,cd_max:%s&tbm=nws"
ENCYCLOPEDIA_URL = "https://en.wikipedia.org/wiki/Portal:Current_events/%s"
WINDOW_DATE_FORMAT = "MM/dd/yyyy"
MONTH_FORMAT = "MMMM_yyyy"

# --- Fixed values: weekdays, Monday first ---------------------------------------
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# --- Fixed values: keywords and topics -----------------------------------------
KEYWORD_MAX_FEATURES = 1000
KEYWORD_MIN_DF = 3
KEYWORD_MAX_DF = 0.90
TOPIC_MAX_FEATURES = 2000
TOPIC_MIN_TITLES = 5
TOPIC_MAX_CLUSTERS = 5
TOPIC_POSTS_PER_CLUSTER = 8
TOPIC_TERMS = 6
TOPIC_EXAMPLES = 3
TOPIC_STARTS = 10
TOPIC_SEED = 42

# --- Fixed values: author network ----------------------------------------------
AUTHOR_NODE_SIZE = 10.0
SUBREDDIT_NODE_BASE = 20.0
SUBREDDIT_NODE_STEP = 1.5

# --- Fixed values: briefing ----------------------------------------------------
BRIEFING_SUBREDDITS = 3
SUGGESTION_TITLES = 8
SUGGESTION_SUBREDDITS = 5
SUGGESTIONS = 3
CHAT_ROWS = 15
QUESTIONS_WHEN_EMPTY = (
    "Summarize the main themes",
    "What is the sentiment trend?",
    "Identify key opinion leaders",
)
QUESTIONS_WHEN_FAILED = (
    "Analyze the sentiment",
    "Who are the top authors?",
    "Summarize the controversy",
)
NO_DATA = "No data available."
