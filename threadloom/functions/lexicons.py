"""Word lists. All are defaults; every operator takes its own instead."""

# Terms and patterns that scores and tags are defined by.
OPINION_PATTERNS = [
    r"\b(i|i'm|i've|i'll|my|mine|personally|imo|imho)\b",
    r"\b(love|hate|great|terrible|awful|amazing|brilliant|stupid|useless|essential)\b",
    r"\b(really|very|extremely|totally|absolutely|definitely|clearly|obviously)\b",
    r"\b(should|shouldn't|must|recommend|suggest|avoid|prefer)\b",
    r"\b(found|tried|tested|using|switched|experience|noticed)\b",
]
RELEVANCE_TERMS = {
    "ai_tools": ["copilot", "cursor", "codex", "codeium", "tabnine", "ai assistant", "llm", "gpt", "chatgpt", "claude"],
    "productivity": ["productivity", "efficient", "faster", "slower", "speed", "accelerate", "boost", "improve", "workflow", "flow state"],
    "vibe_coding": ["vibe", "vibe coding", "vibes", "feel", "experience", "intuitive", "natural", "seamless"],
    "issues": ["hallucination", "bug", "error", "wrong", "mistake", "problem", "issue", "regression", "context"],
    "comparison": ["better than", "worse than", "compared to", "vs", "prefer", "instead of", "replaced"],
}
TOPIC_TERMS = {
    "copilot": ["copilot"],
    "cursor": ["cursor"],
    "codex": ["codex", "openai"],
    "ai-tools": ["codeium", "tabnine"],
    "productivity": ["productivity", "efficient", "faster"],
    "developer-experience": ["vibe", "flow", "experience"],
    "issues": ["hallucination", "bug", "error", "wrong"],
    "learning": ["learn", "junior", "education"],
}
ADVERT_TERMS = [
    "sign up now", "subscribe to my", "link in bio", "buy now", "pre-order", "preorder", "limited time", "discount code", "use code",
    "promo code", "50% off", "70% off", "free trial", "money back", "lifetime access", "early bird", "bootcamp", "webinar",
    "free training", "growth hacking", "passive income", "dm me", "i'll send you", "check out my course", "my newsletter",
]
JOB_TERMS = [
    "hiring", "hire", "apply now", "salary", "years of experience", "job requirement", "qualifications", "full-time", "benefits",
    "recruiting", "competitive pay", "join our team", "ai accelerator", "howto", "iptv",
]
PAYWALL_TERMS = ["member-only story", "you've read all your free member-only stories", "open in app", "this post is for paid subscribers", "this post is for paying subscribers", "subscribe to continue reading"]
TOOL_ALIASES = {"claude": "Claude", "copilot": "Copilot", "github copilot": "Copilot", "cursor": "Cursor", "chatgpt": "ChatGPT", "gemini": "Gemini"}
STOP_WORDS = {
    "en": "the of and to a in is that it for on with as was are be this by at an or not from".split(),
    "de": "der die das und ist in den von zu mit nicht ein eine auf für im dem des sich auch".split(),
    "es": "el la de que y a en un ser se no por con para una su los las del como".split(),
    "fr": "le la les de des et un une est que en du pour dans qui sur pas au avec ce".split(),
}
