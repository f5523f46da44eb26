"""Word lists, phrases and rates used by the operators.

Everything below is a fixed value: results depend on these exact words.
"""

# --- fixed values: missing and yes/no words -------------------------------------
NULL_WORDS_RENDER = ["NULL", "NONE", "NA", "N/A", "", "NAN", "NIL", "MISSING"]
NULL_WORDS_SENTENCE = ["NULL", "NONE", "N/A", ""]
NULL_WORDS_PROFILE = ["NULL", "NONE", ""]
TRUE_WORDS = ["1", "TRUE", "YES", "Y", "T", "ACTIVE", "ENABLED", "ON"]
FALSE_WORDS = ["0", "FALSE", "NO", "N", "F", "INACTIVE", "DISABLED", "OFF"]
BINARY_WORDS_SENTENCE = ["0", "1", "true", "false", "True", "False", "TRUE", "FALSE"]
BOOL_WORDS_PROFILE = ["true", "false", "0", "1", "yes", "no", "y", "n", "t", "f"]

# --- fixed values: phrases that express missing and yes/no values ----------------
EXPLICIT_NULL_PHRASES = ["null", "none", "n/a", "na", "nil", "empty"]
IMPLICIT_NULL_PHRASES = [
    "not specified", "is unspecified", "remains unspecified", "is not detailed",
    "unspecified", "no specified", "an unspecified", "not detailed",
    "lacks a specified", "has not been specified", "does not specify",
    "remains not specified", "is not specified", "is absent", "not available",
    "unavailable", "unknown", "not provided", "not given", "missing",
    "not recorded", "not listed", "not mentioned", "not defined",
    "information unavailable", "data not provided", "not disclosed",
    "undisclosed", "left blank", "not entered", "no information available",
    "details not provided",
]
EXPLICIT_TRUE_PHRASES = ["1", "true", "yes", "y", "t"]
EXPLICIT_FALSE_PHRASES = ["0", "false", "no", "n", "f"]
IMPLICIT_TRUE_PHRASES = [
    "is a", "operates as a", "functions as a", "is designated as a",
    "serves as a", "operates virtually", "provides", "is currently active",
    "is in active status", "is operational", "remains active", "is active",
    "is enabled", "is confirmed", "is approved", "is verified", "is valid",
    "is applicable", "designated as such", "classified as such",
    "functions as", "serves as", "has been confirmed",
]
IMPLICIT_FALSE_PHRASES = [
    "does not operate as a", "is not a", "is not designated as a",
    "does not function as a", "does not operate virtually", "does not provide",
    "is currently inactive", "is not active", "is not operational",
    "has inactive status", "is inactive", "is disabled", "not confirmed",
    "not approved", "not verified", "not valid", "not applicable",
    "not designated as such", "not classified as such", "does not operate as",
    "does not function as", "does not serve as", "has not been confirmed",
]
NAMED_NULL_PHRASES = ["not specified", "unspecified", "is not specified", "none", "null"]
UNNAMED_NULL_PHRASES = [
    "not specified", "is unspecified", "remains unspecified", "is not detailed",
    "unspecified", "no specified", "an unspecified", "not detailed",
    "lacks a specified", "has not been specified", "does not specify",
    "remains not specified", "is not specified", "is absent", "none", "null",
    "not available", "unavailable", "unknown", "not provided", "not given",
    "missing", "not recorded", "not listed", "not mentioned", "not defined",
]

# --- fixed values: characters of a MISC value and the words for them --------------
MISC_CHARACTERS = "!@#$%^&*()-_+=~`{}[]\\|:;'\"<,>./?…•–—―·°±×÷€£¥©®™§¶†‡"
MISC_WORDS_NAMED = {
    "-": ["not specified", "unspecified", "not available"],
    "+": ["plus", "positive", "added", "additional"],
}
MISC_WORDS = {
    "-": ["dash", "hyphen", "minus", "en-dash", "em-dash", "not specified",
          "unspecified", "not available", "unavailable", "unknown", "missing",
          "not provided", "not recorded", "none", "absent", "no data",
          "not applicable", "n/a", "not given", "not listed", "not mentioned",
          "not defined", "is absent"],
    "--": ["double dash", "double hyphen", "em-dash"],
    "---": ["triple dash", "horizontal rule"],
    "/": ["slash", "forward slash", "solidus"],
    "\\": ["backslash", "back slash"],
    "*": ["asterisk", "star"],
    "**": ["double asterisk", "bold marker"],
    "#": ["hash", "pound", "number sign", "hashtag"],
    "@": ["at", "at symbol", "at sign"],
    "&": ["ampersand", "and symbol"],
    "%": ["percent", "percentage"],
    "$": ["dollar", "dollar sign"],
    "!": ["exclamation", "exclamation mark", "bang"],
    "?": ["question mark", "question"],
    ".": ["period", "dot", "full stop"],
    "..": ["double dot", "range"],
    "...": ["ellipsis", "dots", "three dots"],
    "…": ["ellipsis", "dots"],
    ",": ["comma"],
    ":": ["colon"],
    ";": ["semicolon", "semi-colon"],
    "_": ["underscore", "underline"],
    "__": ["double underscore"],
    "+": ["plus", "plus sign", "positive", "added", "additional", "and more",
          "extra", "addition", "admitted", "inpatient", "hospitalized",
          "enrolled", "registered", "confirmed", "approved", "accepted",
          "included", "present", "yes"],
    "=": ["equals", "equal sign", "equals sign"],
    "~": ["tilde", "approximately"],
    "`": ["backtick", "grave accent"],
    "^": ["caret", "circumflex"],
    "()": ["parentheses", "brackets"],
    "(": ["open parenthesis", "left parenthesis", "opening bracket"],
    ")": ["close parenthesis", "right parenthesis", "closing bracket"],
    "[]": ["square brackets", "brackets"],
    "[": ["open bracket", "left bracket"],
    "]": ["close bracket", "right bracket"],
    "{}": ["curly braces", "braces"],
    "{": ["open brace", "left brace"],
    "}": ["close brace", "right brace"],
    "|": ["pipe", "vertical bar", "bar"],
    "<": ["less than", "left angle bracket"],
    ">": ["greater than", "right angle bracket"],
    "<>": ["angle brackets", "diamond"],
    "'": ["apostrophe", "single quote"],
    '"': ["quote", "double quote", "quotation mark"],
    "–": ["en-dash", "dash", "not specified", "unspecified"],
    "—": ["em-dash", "long dash", "not specified", "unspecified"],
    "•": ["bullet", "bullet point"],
    "·": ["middle dot", "interpunct"],
    "°": ["degree", "degree symbol"],
    "±": ["plus-minus", "plus or minus"],
    "×": ["times", "multiplication"],
    "÷": ["division", "divide"],
}

# --- fixed values: wording --------------------------------------------------------
TRANSITIONS = [
    "Furthermore,", "Additionally,", "Moreover,", "In addition,", "Meanwhile,",
    "Subsequently,", "Consequently,", "As a result,", "Building on this,",
    "In this context,", "Similarly,", "Notably,",
]
NO_TRANSITION_STARTS = ["the ", "this ", "these ", "that "]
CLOSING_PHRASES = [
    "Lastly,", "On a final note,", "To conclude,", "Finally,", "In closing,",
    "As a concluding remark,", "To wrap up,",
]
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]
ID_LIKE_KEYWORDS = ["id", "code", "number", "count", "year", "grade",
                    "reputation", "view", "vote", "rank", "score", "size",
                    "amount", "total"]

# --- fixed values: patterns -------------------------------------------------------
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
DATE_STARTS = (r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}"
               r"|\d{4}/\d{2}/\d{2}|\d{1,2}-\w{3}-\d{2,4}|\w{3}\s+\d{1,2},?\s+\d{4}|\d{8})")
DATE_WHOLE = r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{2}/\d{2})$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_START = r"^https?://"
TAG = r"\(Hash:\s*([a-f0-9]+)\)"
CLEANUPS = [
    (r"\brow value for\b", ""),
    (r"\bindicates that\b", "shows"),
    (r"\bthe value\b", "the figure"),
    (r"\brecorded as\b", "showing"),
    (r"\b(\w+)\s+Name\s+of\b", ""),
    (r"\bPercent \(%\) \w+ [^']*'s?\b", "percentage"),
    (r"\b\w+ Count \([^)]+\)\b", "count"),
    (r"\bEnrollment \([^)]+\)\b", "total enrollment"),
]
