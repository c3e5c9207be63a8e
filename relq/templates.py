"""Template data for sample generation and chat rendering.

FIXED VALUES: the strings below must equal the ones the sample format was
defined with, character for character, or the generated samples, prompts and
masks change.  They are listed in their natural order.
"""

from __future__ import annotations

# ---- fixed values: sample generation -------------------------------------------------

INSTRUCTIONS = [
    "Decide whether the document is relevant to the query. Output JSON with 'relevant' and 'reason'.",
    "Evaluate if the following news article matches the user query. Respond in JSON.",
    "Determine the relevance of the document to the query. Answer using JSON format.",
    "Is the document relevant to the given query? Provide a JSON answer with reasoning.",
]

LABEL_TO_QUERIES = {
    0: [
        "Give me world news",
        "International news articles",
        "News about global events and politics",
        "I want news about global events.",
        "Show me international news.",
        "News from around the world, please.",
    ],
    1: [
        "Give me sports news",
        "News about sports events and competitions",
        "Latest updates in sports",
        "I'm looking for the latest sports updates.",
        "Show me headlines about sports.",
        "Any recent sports news?",
    ],
    2: [
        "Give me business news",
        "News about companies and markets",
        "Business and financial news",
        "I want updates on the market and companies.",
        "Show me corporate or financial news.",
        "News about business and finance, please.",
    ],
    3: [
        "Give me science and technology news",
        "Technology or science-related articles",
        "News about scientific and technological developments",
        "I'm interested in science and technology updates.",
        "Show me news about new tech or research.",
        "Anything new in science or technology?",
    ],
}

LABEL_TO_TOPIC = {
    0: "world",
    1: "sports",
    2: "business",
    3: "science and technology",
}

# v1 samples carry a plain-string reason.
POS_REASONS = {
    0: "The article discusses international events and global affairs, which matches the world news topic.",
    1: "The article is about sports events or competitions, aligning with the sports query.",
    2: "The article discusses companies, markets, or financial performance, which fits business news.",
    3: "The article focuses on scientific or technological developments, matching the query.",
}

NEG_REASONS = {
    0: "The article does not focus on global or international events.",
    1: "The article is not related to sports or athletic activities.",
    2: "The article does not discuss business, companies, or financial topics.",
    3: "The article is not related to science or technology topics.",
}

# Summary sentence of the v2 reason: "The document discusses {topic}, which {matches|does not match} the query."
SUMMARY_PREFIX = "The document discusses "
SUMMARY_MATCH = ", which matches the query."
SUMMARY_NO_MATCH = ", which does not match the query."

# ---- fixed values: prompts ---------------------------------------------------------

SYSTEM_BASE = "You are a helpful assistant that evaluates relevance between a query and a document."
SYSTEM_JSON = "You are a helpful assistant that evaluates relevance between a query and a document. Always respond in valid JSON."
SYSTEM_STAGE1 = SYSTEM_BASE + "Answer with only one word: true or false."  # joined without a space
SYSTEM_STAGE2 = SYSTEM_BASE + "Provide a structured reasoning for why the document is relevant or not."
SYSTEM_RAG = "You evaluate relevance between a query and a document. Respond in valid JSON."

# variant -> (system text, user layout).  Layouts:
#   "instruction_input": "{instruction}\n{input}"
#   "instruction_qd":    "{instruction}\n\nQuery: {query}\nDocument: {document}"
#   "qd":                "Query: {query}\nDocument: {document}"
#   "smoke":             the second instruction, then "\nQuery: {query}\nDocument: {document}"
PROMPT_VARIANTS = {
    "train_s1": (SYSTEM_STAGE1, "instruction_input"),
    "train_s2": (SYSTEM_STAGE2, "instruction_input"),
    "train_v1": (SYSTEM_JSON, "instruction_input"),
    "eval_s1": (SYSTEM_JSON, "instruction_input"),
    "eval_v1": (SYSTEM_JSON, "instruction_input"),
    "eval_s2": (SYSTEM_JSON, "instruction_qd"),
    "rag": (SYSTEM_RAG, "qd"),
    "smoke": (SYSTEM_JSON, "smoke"),
}

# ChatML markers (configurable); EOS of the base model, also used as the pad token.
CHATML = {
    "start": "<|im_start|>",
    "end": "<|im_end|>",
    "eos": "<|endoftext|>",
}

# ---- stand-in corpus ------------------------------------------------------------------

# The test corpus has four languages; label = position in this list (4 classes, as in the sample format).
LANG_LABELS = ["de", "en", "es", "fr"]

NUM_LABELS = len(LABEL_TO_TOPIC)
DEFAULT_SEED = 42
MAX_TOKENS = 192
ANSWER_KEY = '"relevant"'
