"""Word lists and constants that results depend on. Fixed values; every operator takes them as a parameter."""

from __future__ import annotations

# Names of countries, other names of them, and adjectives of nationality.
COUNTRIES = (
    "India", "Russia", "China", "Brazil", "South Africa", "Egypt", "Ethiopia", "Iran", "United Arab Emirates", "Saudi Arabia",
    "Indonesia", "Turkey", "United States", "United Kingdom", "France", "Germany", "Japan", "Italy", "Canada", "Australia",
    "Mexico", "Argentina", "Nigeria", "Kenya", "Vietnam", "Bangladesh", "Pakistan", "Sri Lanka", "Nepal", "Kazakhstan",
    "Belarus", "Ukraine", "Poland", "Spain", "Netherlands", "Singapore", "Malaysia", "Thailand", "South Korea", "North Korea",
    "Israel", "Qatar", "Kuwait",
)
COUNTRY_ALIASES = {
    "USA": "United States", "U.S.": "United States", "US": "United States", "America": "United States", "UK": "United Kingdom",
    "U.K.": "United Kingdom", "Britain": "United Kingdom", "UAE": "United Arab Emirates", "Republic of India": "India",
    "Russian Federation": "Russia",
}
DEMONYMS = {
    "Indian": "India", "Russian": "Russia", "Chinese": "China", "Brazilian": "Brazil", "South African": "South Africa",
    "Egyptian": "Egypt", "Ethiopian": "Ethiopia", "Iranian": "Iran", "Emirati": "United Arab Emirates", "Saudi": "Saudi Arabia",
    "Indonesian": "Indonesia", "Turkish": "Turkey", "American": "United States", "British": "United Kingdom", "French": "France",
    "German": "Germany", "Japanese": "Japan", "Italian": "Italy", "Canadian": "Canada", "Australian": "Australia",
    "Mexican": "Mexico", "Argentine": "Argentina", "Nigerian": "Nigeria", "Kenyan": "Kenya", "Ukrainian": "Ukraine",
    "Kazakh": "Kazakhstan", "Pakistani": "Pakistan",
}
# Role titles, head nouns of events, topics and their canonical form.
ROLES = (
    "Prime Minister", "Deputy Prime Minister", "President", "Vice President", "Finance Minister", "Foreign Minister",
    "Deputy Foreign Minister", "External Affairs Minister", "Defence Minister", "Defense Minister", "Home Minister",
    "Commerce Minister", "Trade Minister", "Minister of State", "Chief Minister", "Chancellor", "Secretary of State",
    "Foreign Secretary", "Chief Executive Officer", "Chief Executive", "Managing Director", "Executive Director",
    "Director General", "Chairman", "Chairperson", "Chairwoman", "Chair", "Governor", "Ambassador", "Spokesperson",
    "Secretary General", "Chief Economist", "Chief Financial Officer",
)
EVENT_NOUNS = ("Summit", "Declaration", "Conference", "Forum", "Assembly", "Session", "Plenary", "Olympics", "Games", "Congress", "Convention", "Accord", "Treaty")
TOPICS = {
    "artificial intelligence": "artificial intelligence", "AI": "artificial intelligence", "civil nuclear energy": "civil nuclear energy",
    "nuclear energy": "nuclear energy", "energy cooperation": "energy cooperation", "climate change": "climate change",
    "cybersecurity": "cybersecurity", "cross-border payment system": "cross-border payments", "payment systems": "cross-border payments",
    "national currencies": "trade in national currencies", "crude supply": "crude supply", "defence ties": "defence cooperation",
    "global governance": "global governance", "grain trading": "grain trading", "compute infrastructure": "compute infrastructure",
    "infrastructure projects": "infrastructure", "connectivity": "connectivity", "skilling": "skilling",
}
# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "rev", "hon", "gen", "capt", "col", "lt", "sgt", "gov", "sen", "rep", "amb", "inc", "ltd",
    "co", "corp", "plc", "pvt", "llc", "llp", "assn", "bros", "no", "vs", "etc", "eg", "ie", "al", "fig", "vol", "pp", "approx", "est", "rs", "usd",
    "dept", "univ", "min", "max", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sept", "sep", "oct", "nov", "dec", "mon", "tue", "wed", "thu",
    "fri", "sat", "sun", "u.s", "u.k", "u.n", "e.u", "d.c", "govt", "natl",
)
# Pronouns by what they can refer to, and all pronominal forms.
MASCULINE = (
    "he", "him", "his", "himself",
)
FEMININE = (
    "she", "her", "hers", "herself",
)
NEUTER = (
    "it", "its", "itself",
)
PLURAL = (
    "they", "them", "their", "theirs", "themselves",
)
PRONOUNS = (
    "i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "we", "us", "our", "ours", "ourselves", "they", "them", "their", "theirs", "themselves", "who", "whom", "whose",
    "which", "that", "this", "these", "those",
)
# Words that names are compared without.
COREF_HONORIFICS = (
    "mr", "mrs", "ms", "dr", "prof", "sir", "shri", "smt",
)
HONORIFICS = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "dame", "shri", "smt", "sri", "hon", "rev", "fr", "st",
)
TITLE_SHORT = (
    "pm", "cm", "fm", "hm", "dy", "deputy", "ceo", "cfo", "cto", "coo", "mp", "mla", "gov", "sen", "rep", "amb", "pres", "vp", "sec", "gen", "lt",
    "col", "capt", "maj",
)
ORG_SUFFIXES = (
    "ltd", "limited", "inc", "incorporated", "corp", "corporation", "co", "company", "plc", "llc", "llp", "pvt", "private", "group", "holdings", "sa",
    "ag", "nv", "gmbh", "bv",
)
ORG_STOPWORDS = (
    "the", "of", "and", "for", "in", "at", "on", "de", "la", "du",
)
NOT_NAMES = (
    "rs", "usd", "eur", "inr", "gbp", "crore", "lakh", "bn", "mn", "ceo", "cfo", "gdp", "ai",
)
NAME_FINAL = (
    "inc", "ltd", "co", "corp", "plc", "pvt", "llc", "llp", "bros", "jr", "sr", "st", "mt",
)
# Trust in an extractor's label, specificity of labels, order of preference for a coreference link.
TRUST = {
    "transformer": {"PERSON": 0.95, "ORG": 0.88, "LOCATION": 0.85, "MISC": 0.30},
    "spacy": {"PERSON": 0.70, "ORG": 0.60, "LOCATION": 0.80, "EVENT": 0.55, "DATE": 0.90, "MISC": 0.25},
    "gazetteer": {"COUNTRY": 0.98, "ROLE": 0.95, "EVENT": 0.90, "TOPIC": 0.82, "MISC": 0.40},
}
DEFAULT_TRUST = 0.50
SPECIFICITY = {"COUNTRY": 5, "ROLE": 5, "EVENT": 4, "TOPIC": 4, "PERSON": 3, "ORG": 3, "LOCATION": 2, "DATE": 2, "MISC": 0}
LINK_ORDER = ("PERSON", "ORG", "EVENT", "TOPIC", "LOCATION", "COUNTRY", "ROLE", "DATE", "MISC")
# Labels of two public tag sets in this library's own; a label without an entry is dropped.
LABELS = {
    "spacy": {"PERSON": "PERSON", "ORG": "ORG", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "EVENT": "EVENT", "NORP": "MISC", "DATE": "DATE",
              "LAW": None, "LANGUAGE": None, "PRODUCT": None, "WORK_OF_ART": None, "MONEY": None, "PERCENT": None, "QUANTITY": None, "CARDINAL": None, "ORDINAL": None, "TIME": None},
    "transformer": {"PER": "PERSON", "ORG": "ORG", "LOC": "LOCATION", "MISC": "MISC"},
}
# What a predicate's subject and object may be; triggers of predicates; text between adjacent mentions.
ARGUMENTS = {
    "holds_position": (("PERSON",), ("ROLE",)), "represents": (("PERSON",), ("COUNTRY",)), "works_for": (("PERSON",), ("ORG",)),
    "attended": (("PERSON",), ("EVENT",)), "met": (("PERSON",), ("PERSON", "ORG")), "discussed": (("PERSON", "ORG"), ("TOPIC", "EVENT")),
    "said": (("PERSON", "ORG"), ("TOPIC", "EVENT")), "located_in": (("EVENT", "ORG"), ("LOCATION", "COUNTRY")), "signed": (("PERSON", "ORG"), ("EVENT",)),
}
VERBS = {
    "meet": "met", "greet": "met", "receive": "met", "host": "met", "discuss": "discussed", "review": "discussed", "address": "discussed", "say": "said",
    "tell": "said", "state": "said", "add": "said", "attend": "attended", "arrive": "attended", "join": "attended", "sign": "signed", "adopt": "signed",
    "chair": "works_for", "head": "works_for", "lead": "works_for", "represent": "represents",
}
VERB_NOUNS = {("hold", "talk"): "met", ("hold", "meeting"): "met", ("have", "talk"): "met", ("hold", "discussion"): "discussed"}
MODALS = (
    "may", "might", "could", "would", "should", "will", "plan", "expect", "schedule",
)
JOINERS = ("", ",", "the", ", the", "of", "of the", ", who is", "-", "&")
OF_JOINERS = ("of", "of the", "at", "at the")
ADJACENT, APPOSITIVE, OF_ORG, DIRECT, PREPOSITION, COREF_FACTOR, MODAL_FACTOR, MIN_CONFIDENCE = 0.90, 0.78, 0.85, 0.75, 0.65, 0.85, 0.70, 0.35
# Weights of a pair's features, thresholds of the decision, tiers of name compatibility.
WEIGHTS = {"name": 0.35, "alias": 0.18, "context": 0.12, "role": 0.12, "org": 0.10, "country": 0.08, "temporal": 0.05}
MATCH, REVIEW = 0.55, 0.35
NAME_SUBSET, NAME_FUZZY, DECAY_DAYS, NOISY_CAP = 0.80, 0.70, 90.0, 0.99
MIN_BODY, CONTEXT = 120, 1000
# Cleaned texts, and so all offsets, must be equal character for character; so these are the signs, tags and
# marks that cleaning knows, and where a sentence and an event end.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"
PLAIN_SIGNS = {
    "\u2018": "'",
    "\u2019": "'",
    "\u201a": "'",
    "\u201b": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u201e": '"',
    "\u201f": '"',
    "\u2013": '-',
    "\u2212": '-',
    "\u00a0": ' ',
    "\u202f": ' ',
    "\u2009": ' ',
}
DASH, ELLIPSIS = (" - ", "...")
DROPPED_TAGS = ("script", "style", "noscript", "template")
BLOCK_TAGS = ("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "tr", "td", "th", "table")
CITATION_MARKS = (r"\d{1,3}", "[a-z]", "citation needed", r"note \d+")
SENTENCE_END = r"([.!?]+[\"')\]]*)(\s+)(?=[\"'(\[]*[A-Z0-9])"
EVENT_LEAD = r"(?:\d{1,3}(?:st|nd|rd|th)\s+)?(?:[A-Z][\w.\-]*\s+){0,3}"
# Fixed value: a timestamp that states its offset, as ISO 8601 writes it.
ZONED = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})"
