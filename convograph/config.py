"""Fixed values the results depend on."""

from __future__ import annotations

#: weight of one co-occurrence by its context; any other context counts 1
CONTEXT_WEIGHTS = {"sentence": 5, "paragraph": 2}
OTHER_WEIGHT = 1

#: relation → phrases that state it when they occur anywhere in a lower-cased sentence
RELATION_TRIGGERS = {
    "USES": ("uses", "utilizes", "runs on", "powered by"),
    "DEPENDS_ON": ("depends on", "requires", "relies on"),
    "IMPLEMENTS": ("implements", "provides", "supports"),
    "OPTIMIZES": ("optimizes", "improves", "accelerates"),
    "CAUSES": ("causes", "leads to", "results in"),
    "COMPETES_WITH": ("competes with", "alternative to"),
}

#: whole terms that are never topics or entities ("yes" is none of them, see the README)
STOP_TERMS = (
    "gemini", "json", "markdown", "response", "prompt", "timestamp", "platform", "source", "hash", "question", "answer", "content",
    "code", "file", "text", "data", "string", "output", "input", "message", "result", "information", "label", "html", "title", "the",
    "this", "what", "hey", "you", "they", "for", "she", "he", "while", "can", "why", "your", "here", "claude", "uses", "using", "used",
    "causes", "cause", "handles", "handle", "improves", "improve", "supports", "support", "based", "results", "depends", "relies",
    "requires", "provides", "makes", "create", "creates", "generated", "example", "examples", "system", "process", "method", "approach",
    "implementation",
)
#: single verbs that are no entities
VERBS = ("uses", "causes", "handles", "using", "based", "improves", "results", "depends", "supports")
ENTITY_LABELS = ("person", "organization", "location", "concept", "technology", "product", "event", "research topic", "scientific concept")
TOPIC_FORBIDDEN = "{}[]()/\\=:;<>@#$%^&*|"
TOPIC_OPENINGS = ("the ", "this ", "that ")

TOPIC_LEAST, TOPICS_PER_DOC = 8, 25
ENTITY_LEAST, ENTITIES_PER_DOC = 2, 50
MAX_CHUNK_CHARS, MAX_MODEL_CHARS, MAX_FILE_CHARS = 4_000, 1_200, 700_000
TOP_K, MAX_NEIGHBORS = 10, 5

#: graph colour groups: query → hex colour
COLOR_GROUPS = (
    ("path:entities", "4C8DFF"), ("path:topics", "B57BEE"), ('path:"conversations/claude"', "E8833A"),
    ('path:"conversations/chatgpt"', "3FBF8F"), ('path:"conversations/gemini"', "E85D9E"), ('path:"conversations/claude-code"', "008300"),
)

# Link patterns: each consumer reads links its own way.
EDGE_LINK = r"\[\[([^\]|]+)"
RELATION_LINK = r"\[\[([^\|\]]+)(?:\|.*?)?\]\]"
CHUNK_LINK = r"\[\[([^|\]]+)(?:\|[^\]]+)?\]\]"
MODEL_NAME = r"\b(?:GPT|Gemma|Llama|BERT)\-?[A-Za-z0-9\.]*\b"
DOTTED_NAME = r"\b[a-zA-Z_]+\.[a-zA-Z_]+\b"
