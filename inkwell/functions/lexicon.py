"""Word lists. Those under "fixed values" define behaviour; the rest stand in for a tagger and are labelled so by `_lex` in results."""

from __future__ import annotations

# Rhetoric.
DESCRIPTIVE = ["is a raw", "is a clear", "is a good", "is a bad", "is a perfect", "is a typical", "is an example", "is a case", "is a instance", "is a clear example", "is a good example", "is a perfect example"]
DEFINITION = ["is a", "is an", "means", "refers to", "defined as", "is defined"]
IMPERATIVE = ["study", "learn", "consider", "remember", "note", "observe", "understand", "recognize", "examine", "analyze", "think"]
ARGUMENT = ["therefore", "thus", "hence", "because", "since", "consequently", "accordingly", "as a result", "for this reason", "so"]

# Template validity.
NAVIGATION_STARTS = ["return to", "back to", "continued on", "see page", "table of contents", "see figure", "see chapter", "see section", "refer to", "see above", "see below", "continued from", "go to", "jump to"]
NAVIGATION = ["return to", "continued on", "see page", "refer to"]
LOGIC_STARTERS = ["Therefore", "Consequently", "Thus", "Hence", "Accordingly", "However", "Nevertheless", "Furthermore", "Moreover", "In contrast", "It is", "There is", "That is"]

# Pronouns.
VOICE_FIRST = ["i", "me", "my", "mine", "we", "us", "our", "ours"]
VOICE_SECOND = ["you", "your", "yours"]
VOICE_THIRD = ["he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs"]
FIRST_SINGULAR = ["i", "me", "my", "myself", "mine"]
FIRST_PLURAL = ["we", "us", "our", "ourselves", "ours"]
THIRD_PERSON = ["he", "she", "it", "they", "him", "her", "them", "his", "hers", "its", "their", "theirs"]

# Sentence types.
QUESTION_STARTS = ["who ", "what ", "where ", "why ", "how "]
WHEN_QUESTION = r"^when\s+(did|do|does|will|would|can|could|should|is|are|was|were|has|have|had)\s"
CONDITIONAL_START = r"^(if|unless|provided that|should)\s"

# Repetition and echo.
GLUE = ["of the", "in the", "to the", "and the", "that the", "is a", "is the", "the the", "a the", "an the", "for the", "with the", "from the"]
ECHO_COMMON = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "is", "was", "are", "were", "it", "this", "that", "these", "those"]
OPENER_EXEMPT = ["the", "a", "an"]

# Completeness and coherence.
DANGLING = ["and", "or", "but", "the", "a", "of", "in", "to", "with"]
CAPITAL_EXEMPT = ["of", "as", "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by"]

# Openers.
LOGICAL_OPENERS = ["therefore", "however", "moreover", "furthermore", "consequently", "thus", "hence", "accordingly", "nevertheless", "nonetheless"]
NARRATIVE_OPENERS = ["and", "but", "then", "so", "or", "nor", "yet"]
SENSORY_VERBS = ["see", "hear", "feel", "grasp", "watch", "listen", "touch", "smell", "sense", "perceive"]

# Corpus cleaning.
HEADERS = ["Introduction", "Preface", "Chapter", "Contents", "Acknowledgements"]
ROMAN = r"^(I{1,3}|IV|VI{0,3}|IX|X{1,3}|XI{0,3}|XIV|XV|XVI|XVII|XVIII|XIX|XX|XXX)$"
INSTRUCTIONS = ["CRITICAL:", "REWRITE:", "INPUT TEXT:", "TASK:", "INSTRUCTIONS:", "Subjects:", "Actions:", "Objects:", "Entities:", "Keywords:", "Citations:", "Quotes:", "Citations to include:", "Quotes to preserve:", "Citations to preserve:", "Direct quotes to preserve exactly:"]

# Restricted vocabulary and its limits.
RESTRICTED = ["profound", "profoundly", "vast", "vastly", "monumental", "staggering", "colossal", "inexorable", "intricate", "complexity", "alienation"]
MAX_PER_CHAPTER, CLUSTERING_DISTANCE = 0, 50

# Endings.
MORAL_OPENERS = ["in", "ultimately", "essentially", "fundamentally", "thus", "therefore", "hence", "consequently"]
MORAL_NOUNS = ["lesson", "meaning", "significance", "importance", "understanding", "wisdom", "truth", "reality", "nature", "essence", "purpose", "value"]
ABSTRACT = ["lesson", "structure", "system", "humanity", "society", "understanding", "abstract", "meaning", "significance", "essence", "nature", "purpose", "value", "wisdom", "truth"]

# Weights of the composite score.
WEIGHTS = {"accuracy": 0.5, "fluency": 0.1, "style": 0.1, "thesis_alignment": 0.2, "intent_compliance": 0.1, "keyword_coverage": 0.0}

# Stand-ins for a tagger: common English function words and forms.
STOPS = ["a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "is", "it", "its", "my", "no", "not", "of", "on", "or", "our", "she", "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "was", "we", "were", "what", "when", "which", "who", "will", "with", "would", "you", "your"]
BE_FORMS = ["am", "is", "are", "was", "were", "be", "been", "being"]
COORDINATORS = ["and", "but", "or", "nor", "for", "yet", "so"]
SUBORDINATORS = ["after", "although", "as", "because", "before", "if", "since", "that", "though", "unless", "until", "when", "where", "whereas", "which", "while", "who", "whom", "whose", "why", "how"]
POSITIVE = ["good", "great", "happy", "love", "excellent", "best", "beautiful", "wonderful", "bright", "kind"]
NEGATIVE = ["bad", "poor", "sad", "hate", "terrible", "worst", "ugly", "awful", "dark", "cruel"]
