"""Word lists, patterns and constants the results depend on.

Patterns are written with plain ``\\w \\s \\d \\b``; ``functions.text.java`` gives these
classes their Unicode meaning.
"""

from __future__ import annotations

# --- fixed values: chunking ---------------------------------------------------------
SECTION_PATTERNS = [
    r"\n\s*#{1,6}\s+.+\n",
    r"\n\s*\d+\.\s+",
    r"\n\s*[A-Z][A-Z\s]+\n",
    r"\n\s*\n\s*\n",
]

TECHNICAL_INDICATORS = [
    r"\w+\s*\([^)]*\)\s*[{:]",
    r"\b(?:class|method|function|synchronized|thread|lock|mutex)\b",
    r"(?:public|private|static|void|return)\s+\w+",
    r"(?:algorithm|implementation|performance|complexity)",
]

BOUNDARY_PATTERNS = [
    r"\n\s*(?:public|private|protected|static)\s+\w+.*?\n(?=\s*[a-zA-Z])",
    r"\n\s*\w+\(\)\s*[:;]\s*\n",
    r"\n\s*(?:Example|Code|Implementation):\s*\n",
    r"\n\s*(?:\d+\.|\*|-)\s+",
]

METHOD_SIGNATURES = [
    r"\w+\s*\([^)]*\)\s*[{:]",
    r"\w+\(\)\s*[:;]",
    r"(?:public|private|static)\s+\w+",
    r"def\s+\w+\s*\([^)]*\)",
]

TYPED_METHOD = r"(?:public|private|protected)?\s*(?:static)?\s*(\w+)\s+(\w+)\s*\(([^)]*)\)"
PLAIN_METHOD = r"(\w+)\s*\([^)]*\)"
CALL_PATTERN = r"\b(\w+)\s*\(\s*\)"

DOCUMENT_TYPES = [
    ("technical", ["class ", "def ", "import ", "function", "algorithm"]),
    ("academic", ["abstract", "introduction", "methodology", "references"]),
    ("legal", ["whereas", "pursuant", "contract", "agreement"]),
    ("business", ["revenue", "profit", "business", "market"]),
]

# --- fixed values: lexical scoring --------------------------------------------------
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
TFIDF_MAX_FEATURES, TFIDF_MAX_DF, TFIDF_MIN_DF, TFIDF_MIN_SCORE = 10000, 0.8, 2, 0.01
HYBRID_BM25_SCALE = 10.0
METHOD_WEIGHTS = {"dense": 0.5, "bm25": 0.3, "tfidf": 0.2}
METHOD_BONUS = 0.1
RERANK_WEIGHTS = (0.7, 0.3)

# Function words dropped before TF-IDF n-grams; pass another list for other corpora.
TFIDF_STOP_WORDS = (
    "about above after again against all also am an and any are as at be because been "
    "before being below between both but by can cannot could did do does doing down "
    "during each few for from further had has have having he her here hers him his how "
    "if in into is it its itself me more most my no nor not of off on once only or other "
    "our ours out over own same she should so some such than that the their theirs them "
    "then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours"
).split()

# --- fixed values: queries ----------------------------------------------------------
QUERY_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
QUESTION_WORDS = ["what", "how", "when", "where", "who", "why", "which", "define", "explain"]
COMPARISON_WORDS = ["compare", "vs", "difference"]
SUMMARY_WORDS = ["summarize", "summary"]

LANGUAGE_WORDS = [
    ("java", ["java", "jvm", "spring", "hibernate", "thread", "synchronized"]),
    ("python", ["python", "django", "flask", "pandas", "numpy"]),
    ("javascript", ["javascript", "node", "react", "vue", "angular"]),
    ("c++", ["c++", "cpp", "iostream", "namespace", "class"]),
    ("c#", ["c#", "csharp", ".net", "visual studio"]),
    ("go", ["golang", "goroutine", "channel"]),
    ("rust", ["rust", "cargo", "ownership", "borrowing"]),
]

# (type, patterns, keywords, needs precision, route)
QUERY_RULES = [
    (
        "method_comparison",
        [
            r"(\w+\(\))\s*(?:vs|versus|compared?\s+to|difference\s+between)\s*(\w+\(\))",
            r"(?:difference\s+between|compare)\s*(\w+\(\))\s*(?:and|with)\s*(\w+\(\))",
            r"(\w+\(\))\s*(?:or)\s*(\w+\(\))",
        ],
        ["vs", "versus", "compare", "difference", "between", "or"],
        True,
        "multi_method_retrieval",
    ),
    (
        "method_explanation",
        [
            r"(?:what\s+is|explain|describe|how\s+does)\s+(\w+\(\))",
            r"(\w+\(\))\s+(?:method|function)",
            r"purpose\s+of\s+(\w+\(\))",
        ],
        ["what is", "explain", "describe", "how does", "purpose"],
        True,
        "method_focused_retrieval",
    ),
    (
        "synchronization_concepts",
        [
            r"(?:thread|threading|synchronization|concurrency)",
            r"(?:lock|mutex|semaphore|monitor)",
            r"(?:race\s+condition|deadlock|blocking)",
        ],
        ["thread", "sync", "lock", "concurrent", "parallel", "blocking"],
        True,
        "concept_hierarchical_retrieval",
    ),
    (
        "implementation_guide",
        [
            r"how\s+to\s+(?:implement|use|create)",
            r"(?:example|sample|code)\s+(?:of|for)",
            r"(?:syntax|usage)\s+(?:of|for)",
        ],
        ["how to", "implement", "example", "syntax", "usage", "create"],
        False,
        "example_focused_retrieval",
    ),
    (
        "debugging_help",
        [
            r"(?:error|exception|bug|issue|problem)",
            r"(?:why\s+(?:is|does)|what\s+causes)",
            r"(?:not\s+working|fails\s+to)",
        ],
        ["error", "exception", "bug", "issue", "problem", "why", "fails"],
        True,
        "problem_solution_retrieval",
    ),
    (
        "performance_query",
        [
            r"(?:performance|speed|optimization|efficiency)",
            r"(?:faster|slower|optimize|improve)",
            r"(?:memory|cpu|resource)\s+(?:usage|consumption)",
        ],
        ["performance", "speed", "optimization", "faster", "memory"],
        False,
        "best_practice_retrieval",
    ),
]
PATTERN_WEIGHT, KEYWORD_WEIGHT = 0.4, 0.6

CONCEPTS = {
    "yield()": ["cooperative scheduling", "thread yielding", "voluntary pause", "scheduler hint"],
    "join()": ["thread synchronization", "blocking wait", "thread completion", "synchronization barrier"],
    "wait()": ["object monitor", "conditional waiting", "notify/notifyAll", "thread parking"],
    "sleep()": ["timed pause", "thread suspension", "non-blocking delay"],
    "synchronized": ["mutual exclusion", "thread safety", "critical section", "monitor lock"],
    "notify()": ["thread notification", "monitor signaling", "wake waiting threads"],
    "notifyAll()": ["broadcast notification", "wake all waiting threads"],
    "ArrayList": ["dynamic array", "resizable array", "indexed access"],
    "LinkedList": ["linked structure", "sequential access", "node-based"],
    "HashMap": ["hash table", "key-value mapping", "constant time lookup"],
    "TreeMap": ["balanced tree", "sorted mapping", "logarithmic access"],
}
THREADING_CONCEPTS = ["yield()", "join()", "wait()", "sleep()", "synchronized", "notify()", "notifyAll()"]
TECHNICAL_TERMS = [
    "thread", "process", "synchronization", "lock", "mutex", "semaphore",
    "blocking", "non-blocking", "asynchronous", "concurrent", "parallel",
    "deadlock", "race condition", "critical section", "monitor",
    "algorithm", "data structure", "complexity", "performance",
]
PROGRAMMING_WORDS = [
    "java", "python", "javascript", "code", "programming", "method",
    "function", "class", "object", "thread", "process", "algorithm",
    "implementation", "syntax", "api", "library", "framework",
]

# --- fixed values: answer checks ----------------------------------------------------
# method -> (statements that are right, statements that are wrong)
METHOD_FACTS = {
    "yield": (
        [
            "cooperative scheduling hint", "voluntarily pause current thread",
            "allows other threads to run", "no guarantee of thread switching",
            "scheduler dependent", "non-blocking operation",
        ],
        [
            "blocks until completion", "waits for other threads", "synchronization mechanism",
            "main thread completes first", "guarantees execution order",
        ],
    ),
    "join": (
        [
            "blocks calling thread", "waits for target thread completion",
            "synchronization mechanism", "ensures thread finishes", "thread coordination",
            "blocking operation",
        ],
        [
            "cooperative scheduling", "main thread completes before others",
            "non-blocking hint", "voluntary pause", "scheduler hint",
        ],
    ),
    "wait": (
        [
            "object monitor wait", "conditional waiting", "releases monitor lock",
            "waits for notification", "must be in synchronized context",
        ],
        ["thread scheduling", "cooperative yielding", "non-blocking operation"],
    ),
    "sleep": (
        [
            "timed pause", "thread suspension", "does not release locks", "static method",
            "interruption possible",
        ],
        ["cooperative scheduling", "releases monitor locks", "synchronization primitive"],
    ),
}
MISCONCEPTIONS = [
    (r"main thread.*complete.*before", "join() makes the calling thread wait for the target thread to complete"),
    (r"yield.*synchronization", "yield() is for cooperative scheduling, not synchronization"),
    (r"join.*scheduling.*hint", "join() is a synchronization mechanism, not a scheduling hint"),
]
YIELD_TERMS = ["cooperative", "scheduling", "hint", "voluntary"]
JOIN_TERMS = ["synchronization", "blocking", "wait", "completion"]
COMPARISON_FINDINGS = [
    (
        "Missing correct characterization of yield() as cooperative scheduling",
        "yield() is a cooperative scheduling hint that voluntarily pauses the thread",
    ),
    (
        "Missing correct characterization of join() as synchronization mechanism",
        "join() is a synchronization mechanism that blocks until thread completion",
    ),
    (
        "Incorrect explanation: join() doesn't make main thread complete first",
        "join() makes the calling thread wait for the target thread to complete",
    ),
]
CLAIM_STEMS = [
    "blocks", "waits", "synchroniz", "cooperativ", "schedul",
    "thread", "method", "function", "complet", "pause",
]

# --- fixed values: entities and relations -------------------------------------------
ENTITY_TERMS = {
    "TECH": {
        "programming_languages": ["python", "java", "javascript", "typescript", "c++", "c#", "go", "rust", "swift"],
        "frameworks": ["react", "angular", "vue", "django", "flask", "spring", "express", "laravel"],
        "databases": ["mysql", "postgresql", "mongodb", "redis", "sqlite", "oracle", "cassandra"],
        "cloud_platforms": ["aws", "azure", "gcp", "google cloud", "amazon web services"],
    },
    "BUSINESS": {
        "metrics": ["roi", "kpi", "revenue", "profit", "ebitda", "market cap", "valuation"],
        "roles": ["ceo", "cto", "cfo", "manager", "director", "analyst", "consultant"],
    },
    "SCIENCE": {
        "fields": ["machine learning", "artificial intelligence", "data science", "nlp", "computer vision"],
        "methods": ["regression", "classification", "clustering", "neural network", "deep learning"],
    },
}
ENTITY_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("URL", r"https?://[^\s]+"),
    ("PHONE", r"\b\d{3}-\d{3}-\d{4}\b|\b\(\d{3}\)\s*\d{3}-\d{4}\b"),
    ("DATE", r"\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{4}-\d{2}-\d{2}\b"),
]
TERM_CONFIDENCE, PATTERN_CONFIDENCE = 0.8, 0.9
CONTEXT_CHARS = 50

# relation -> connectors between the two word groups, in order of precedence
RELATION_CONNECTORS = [
    ("IS_A", ["is a", "are", "was a"]),
    ("HAS", ["has", "contains", "includes", "owns"]),
    ("USES", ["uses", "utilizes", "employs", "applies"]),
    ("LOCATED_IN", ["in", "at", "located in"]),
    ("CAUSES", ["causes", "leads to", "results in"]),
    ("WORKS_FOR", ["works for", "employed by", "at"]),
]
RELATION_CONFIDENCE = 0.8
ENTITY_PAIR_TOKENS = 15

# --- fixed values: summaries --------------------------------------------------------
SUMMARY_STOP_WORDS = QUERY_STOP_WORDS

# --- fixed values: messages ---------------------------------------------------------
UNSUPPORTED_FORMAT = "Unsupported format: .{}"
TYPE_NOT_SUPPORTED = "File type '{}' not supported"
SIZE_EXCEEDED = "File size exceeds {}MB limit"
METHOD_BEHAVIOR = "{} behavior: {}"
METHOD_CORRECT_BEHAVIOR = "{} correct behavior: {}"
INCORRECT_STATEMENT = "Incorrect statement about {}: contains '{}'"
MISSING_DESCRIPTION = "Missing accurate description of {} behavior"
MISCONCEPTION = "Common misconception detected: {}"
