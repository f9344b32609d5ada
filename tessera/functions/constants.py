"""Fixed values of the retrieval contract."""

# Ingestion.
SEGMENT_MAX_TOKENS = 350
MAX_TS_MS = 253_402_214_400_000
RULE_MAX_CHARS = 400
ROLE_ALIASES = {"human": "user", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant", "chatbot": "assistant", "agent": "assistant"}
IMAGE_TYPES = ("image_url", "image", "input_image")
EMBED_BATCH, EMBED_CLIP, EMBED_DIM = 10, 6000, 1024

# Retrieval.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, VIRTUAL_RANK, CHANNEL_MULTIPLE = 60, 4, 2
TOP_K_CAP, BUDGET_TOKENS = 100, 60_000
NEIGHBOR_RATIO, NEIGHBOR_ANCHORS, NEIGHBOR_RADIUS, NEIGHBOR_AFTER = 0.05, 10, 1, 20
RULE_SLOT, RULE_AFTER = 8, 10
HOP_ANCHORS, HOP_TERMS, HOP_QUERY_WEIGHT, HOP_WEIGHT, HOP_RESERVE = 5, 8, 0.6, 0.6, 20
RERANK_WINDOW, RERANK_MIX = 200, 1.0
DATE_RADIUS = 3

# Channel order and weights by intent.
CHANNELS = ("bm25", "vector", "entity", "literal", "date", "bm25_hop", "vector_hop")
WEIGHTS = {
    "default": {"bm25": 1.0, "vector": 1.0, "entity": 0.8, "literal": 1.0, "date": 0.5},
    "temporal": {"bm25": 1.2, "vector": 0.9, "entity": 0.7, "literal": 1.0, "date": 1.5},
    "latest": {"bm25": 1.0, "vector": 1.0, "entity": 1.0, "literal": 0.8, "date": 0.3},
    "aggregate": {"bm25": 1.0, "vector": 1.0, "entity": 1.4, "literal": 1.0, "date": 0.5},
    "who": {"bm25": 1.0, "vector": 1.0, "entity": 1.4, "literal": 1.2, "date": 0.3},
}

# Calendar names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

# Words that decide the intent of a query, first match in this order.
INTENTS = {
    "latest": (
        ["currently", "now", "nowadays", "these days", "at the moment", "still", "latest", "current", "present"],
        ["现在", "目前", "最近", "如今"],
    ),
    "temporal": (
        ["when", "how long", "how many days", "how many weeks", "how many months", "how many years", "before", "after", "first", "last", "since", "until", "ago", "date", "[0-9]{4}"],
        ["什么时候", "多久", "之前", "之后", "哪天", "哪年"],
    ),
    "aggregate": (
        ["how many", "how much", "all", "list", "which", "every", "each", "what are", "name the", "total"],
        ["有哪些", "多少", "所有", "列出"],
    ),
    "who": (["who", "whose", "whom"], ["谁"]),
}

# Openings of task requests, of factual questions, and phrases of rules.
TASK_OPENERS = [
    "write", "draft", "compose", "help me", "make", "create", "plan", "recommend", "suggest", "give me", "tell me how", "can you", "could you", "would you",
    "i need you to", "i want you to", "let's", "any (?:good |other )?(?:suggestions|recommendations|ideas)",
]
TASK_ANYWHERE = ["帮我", "请你", "给我写", "替我", "帮忙", "推荐"]
FACTUAL_OPENERS = ["what", "when", "who", "whom", "whose", "where", "which", "how (?:many|much|long|old|often)", "did", "do", "does", "is", "was", "were", "are", "has", "have", "had"]
RULE_PHRASES = [
    "always", "never", "from now on", "going forward", "in the future", "please (?:don't|do not|stop|avoid|remember)", "don't ever", "remember to",
    "make sure (?:to|you)", "every time", "whenever you", "i prefer", "i'd prefer", "i don't like it when", "stop (?:using|doing|adding)", "no longer",
]
RULE_ANYWHERE = ["以后", "每次", "别再", "不要再", "记住", "从今以后", "从现在起"]

# Labels before a colon that are no speakers.
NOT_SPEAKERS = """Note Notes Tip Tips Warning Update Summary Answer Question Step Example Task Context Reminder Hint Hints Ps Edit
Result Output Input Error Info Important Remember Topic Subject Re Fyi Idea Plan Goal Status Title Description Prompt Response
System User Assistant""".split()

# Capitalised words that are no names.
NOT_NAMES = """The This That These Those There Here Then Also But And Or So Yes No Ok Okay Hi Hello Hey Thanks Thank
Oh Well What How When Where Why Who Which Whose Because Just Maybe Really Sure Please Sorry Great Good Nice Cool
Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September
October November December Today Tomorrow Yesterday Tonight Morning Evening Night Week Weekend Month Year
Mr Mrs Ms Dr Prof Sir Madam Assistant User Human Bot Google Youtube Netflix Amazon Apple Facebook Instagram Twitter
Reddit Tiktok Zoom Spotify Uber Airbnb Wow Haha Lol Btw Omg Anyway Actually Honestly Basically Finally First Second Third
Last Next New Old Big Small Happy Sad Love Like Hope Wish Think Know Feel Got Get Went Going Come Came Let Make Made
English Spanish French German Chinese Japanese American British European Asian African""".split()

# Words that never extend a query.
HOP_STOP = """the and for that this with have has had was were are you your yours our ours they them their there here
what when where which who whom how why not but can could would should will just also very really about from into than then
them some any all more most much many few lot lots one two three like get got going went make made take took come came
think know want need let see look feel felt say said tell told ask asked yes yeah okay sure thanks thank please sorry
being been does did doing done its it's i'm i've i'd i'll you're we're they're don't didn't doesn't can't won't isn't
because while though although since after before again still even ever never always often sometimes today yesterday
tomorrow week weeks month months year years day days time times thing things something anything nothing everything
user assistant""".split()
