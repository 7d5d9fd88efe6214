"""Word lists, limits and messages that decide results.

They have to equal the published behaviour this library provides, so they are stated
here as plain text and nowhere else.
"""

# --- fixed values: stop words (87) ------------------------------------------------
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "through", "during", "before",
    "after", "above", "below", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once",
)
MIN_WORD_LENGTH = 3

# --- fixed values: message limits ------------------------------------------------
MIN_MESSAGE = 10
MAX_MESSAGE = 10000
SHORT_MESSAGE = 50
PREVIEW = 100

# --- fixed values: known header names of text columns (25) and label columns (19) --
TEXT_NAMES = (
    "text", "email_content", "message", "content", "email",
    "email_text", "body", "mail_content", "text_content",
    "mail_body", "email_body", "msg", "msg_text", "mail_text",
    "description", "comment", "review", "feedback", "note",
    "v1", "v2", "col1", "column1", "data", "input",
)
LABEL_NAMES = (
    "label", "class", "category", "spam", "classification",
    "target", "y", "labels", "spam_label", "class_label",
    "type", "result", "output", "prediction", "ground_truth",
    "is_spam", "spam_flag", "ham_spam", "verdict",
)

# --- fixed values: header keyword groups and what a hit is worth -------------------
TEXT_KEYWORDS = (
    (5, ("text", "email", "message", "content", "mail", "body")),
    (3, ("msg", "description", "comment", "review", "feedback", "note")),
    (1, ("data", "input", "col", "column", "field")),
    (-5, ("label", "class", "spam", "target", "id", "index", "num")),
)
LABEL_KEYWORDS = (
    (5, ("label", "class", "spam", "category", "target", "type")),
    (3, ("result", "output", "prediction", "verdict", "flag")),
    (-5, ("text", "email", "message", "content", "body", "id", "index")),
)
EXACT_NAME_SCORE = 10
HEADER_HINTS = ("text", "email", "message", "content")
ID_HINTS = ("id", "index", "num", "count")

# --- fixed values: class weighting ------------------------------------------------
SPAM_WEIGHT_FACTOR = 1.5
MODEL_SPAM_BOOST = {"random_forest": 2.0, "decision_tree": 1.8}
IMBALANCE_THRESHOLD = 0.45

# --- fixed values: alert thresholds ------------------------------------------------
MAX_PROCESSING_MS = 30000
MAX_MEMORY_MB = 4096
MIN_ACCURACY = 0.90
MAX_FNR = 0.10
MAX_SYNTHETIC_RATIO = 2.0

# --- fixed values: balancing verdicts ----------------------------------------------
TARGET_FNR = 0.05
MIN_ACCURACY_RETENTION = 0.95
MIN_SYNTHETIC_QUALITY = 0.7
DEFAULT_SYNTHETIC_QUALITY = 0.8
MIN_FNR_REDUCTION = 0.01
EFFECTIVENESS_WEIGHTS = {
    "recall_improvement": 0.4,
    "fnr_reduction": 0.3,
    "f1_improvement": 0.2,
    "accuracy_improvement": 0.1,
}

# --- fixed values: error message of a message that cannot be scored -----------------
ERR_NONE = "Email text cannot be None"
ERR_EMPTY = "Email text cannot be empty or only whitespace"
ERR_SHORT = "Email text too short (minimum 10 characters)"
ERR_LONG = "Email text too long (maximum 10000 characters)"
WARN_SHORT = "Email text is very short, classification may be less accurate"
