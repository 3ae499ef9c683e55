"""Fixed values of the risk model: rule catalog, weights, pairs, groups, slang, thresholds."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Rule catalog, (category, severity, pattern), matched case-insensitively.
# The order is the order in which hits are reported.
# ---------------------------------------------------------------------------
RULES: list[tuple[str, int, str]] = [
    ("isolation", 3, r"don'?t\s+tell\s+(your\s+)?(parents?|mum|mom|dad|family|friends?)"),
    ("isolation", 3, r"keep\s+(this|it|our\s+\w+)\s+(a\s+)?secret"),
    ("isolation", 3, r"(just\s+)between\s+(you\s+and\s+me|us)"),
    ("isolation", 2, r"don'?t\s+(let|show)\s+\w+\s+(see|know|find out)"),
    ("isolation", 2, r"(delete|clear)\s+(this|these|the\s+)?(messages?|chats?|conv\w*)"),
    ("meeting", 3, r"(let'?s|wanna|want\s+to|wna)\s+meet(\s+up)?"),
    ("meeting", 3, r"are\s+you\s+(home\s+)?alone"),
    ("meeting", 3, r"(come\s+to|visit)\s+(my|our)\s+(place|house|flat|home|apartment)"),
    ("meeting", 2, r"(hang\s+out|chill)\s+(with\s+me|together|sometime)"),
    ("meeting", 2, r"where\s+do\s+you\s+live"),
    ("age_probing", 2, r"how\s+old\s+are\s+you"),
    ("age_probing", 2, r"what'?s?\s+your\s+age"),
    ("age_probing", 1, r"you('?re|\s+are)\s+(so\s+)?(mature|grown[\s-]up|advanced)\s+for\s+your\s+age"),
    ("age_probing", 1, r"you\s+(seem|look|act)\s+(older|more\s+mature)\s+than\s+\d+"),
    ("image_solicitation", 3, r"send\s+(me\s+)?(a\s+)?(pic(ture)?s?|photo|selfie|snap|nude)"),
    ("image_solicitation", 3, r"show\s+me\s+(your(self)?|a\s+pic|what\s+you\s+look)"),
    ("image_solicitation", 3, r"(got\s+any\s+|have\s+any\s+)?(nudes?|pics?\s+of\s+you)"),
    ("image_solicitation", 2, r"(can\s+i\s+see|let\s+me\s+see)\s+(you|your\s+\w+)"),
    ("rapid_intimacy", 2, r"i'?ve?\s+never\s+(felt|met|found)\s+(anyone|someone|a\s+\w+)\s+like\s+you"),
    ("rapid_intimacy", 2, r"you'?re?\s+(the\s+)?(only\s+one|most\s+\w+\s+person)\s+i\s+(know|trust|have)"),
    ("rapid_intimacy", 1, r"(i\s+)?(really\s+)?(like|love|adore)\s+you\s+(so\s+much|a\s+lot)"),
    ("rapid_intimacy", 1, r"you\s+(are|r)\s+(so\s+)?(beautiful|gorgeous|cute|hot|sexy|perfect)"),
    ("coercion", 3, r"i'?ll\s+(tell|show|send)\s+(everyone|your\s+(parents?|friends?|school))"),
    ("coercion", 2, r"you\s+(promised|said\s+you\s+would)"),
    ("coercion", 2, r"i\s+thought\s+you\s+(trusted?|liked?|loved?)\s+me"),
    ("coercion", 2, r"(after\s+everything|after\s+all)\s+i'?ve?\s+(done|given)\s+(for\s+you|you)"),
    ("sexual_content", 3, r"\b(sex|sexual|intercourse|masturbat\w+|orgasm|erect\w+)\b"),
    ("sexual_content", 3, r"\b(cock|dick|pussy|vagina|penis|boobs?|breasts?|naked|nude)\b"),
    ("platform_migration", 3, r"\b(add|dm|message|text)\s+me\s+on\s+(snap(chat)?|telegram|whatsapp|kik|discord|insta|instagram)\b"),
    ("platform_migration", 3, r"\bwhat'?s\s+your\s+(snap(chat)?|telegram|whatsapp|kik|discord|insta|instagram)\b"),
    ("platform_migration", 3, r"\b(let'?s|we\s+should)\s+(talk|chat|message)\s+(somewhere\s+)?private\b"),
    ("platform_migration", 2, r"\buse\s+(vanish\s+mode|disappearing\s+messages|secret\s+chat)\b"),
    ("platform_migration", 2, r"\bturn\s+on\s+(vanish\s+mode|disappearing\s+messages)\b"),
    ("platform_migration", 2, r"\bdon'?t\s+(save|screenshot|screen\s*record)\s+(this|it|our\s+chat|messages?)\b"),
    ("supervision_probe", 3, r"\bare\s+your\s+(parents?|mum|mom|dad|family)\s+(home|there|around)\b"),
    ("supervision_probe", 3, r"\bare\s+you\s+alone\s+(right\s+now|rn|at\s+home)?\b"),
    ("supervision_probe", 3, r"\bis\s+anyone\s+(watching|with\s+you|near\s+you|in\s+the\s+room)\b"),
    ("supervision_probe", 2, r"\bcan\s+anyone\s+(see|read|check)\s+your\s+(phone|screen|messages?|chat)\b"),
    ("supervision_probe", 2, r"\bdo\s+your\s+parents?\s+(check|read|monitor)\s+your\s+(phone|messages?|apps?|account)\b"),
    ("supervision_probe", 2, r"\b(lock|close)\s+your\s+(door|bedroom\s+door)\b"),
    ("contact_info_probe", 3, r"\b(send|give|share)\s+(me\s+)?your\s+(number|phone\s+number|address|location|pin)\b"),
    ("contact_info_probe", 3, r"\bwhat'?s\s+your\s+(number|phone\s+number|address|location)\b"),
    ("contact_info_probe", 2, r"\bdrop\s+your\s+(pin|location|snap|insta|discord)\b"),
    ("contact_info_probe", 2, r"\bwhere\s+exactly\s+do\s+you\s+live\b"),
    ("contact_info_probe", 2, r"\bwhat'?s\s+your\s+(full\s+name|last\s+name|surname)\b"),
    ("contact_info_probe", 2, r"\bwhat\s+school\s+do\s+you\s+go\s+to\b"),
    ("contact_info_probe", 2, r"\bwhat\s+(bus|train|route)\s+do\s+you\s+take\b"),
    ("routine_probe", 2, r"\bwhat\s+time\s+do\s+you\s+(leave|finish|get\s+out\s+of)\s+(school|class|practice)\b"),
    ("routine_probe", 2, r"\bwhen\s+are\s+you\s+(home|alone|free)\b"),
    ("routine_probe", 2, r"\bwhat\s+days\s+are\s+your\s+parents?\s+(away|working|not\s+home)\b"),
    ("routine_probe", 2, r"\bwhen\s+do\s+you\s+walk\s+home\b"),
    ("routine_probe", 2, r"\bwhere\s+do\s+you\s+hang\s+out\s+after\s+school\b"),
    ("gifts_incentives", 3, r"\bi('?ll| will)\s+(buy|get|send|give)\s+you\s+(a\s+)?(gift|present|phone|card|gift\s*card)\b"),
    ("gifts_incentives", 3, r"\bi('?ll| will)\s+pay\s+you\b"),
    ("gifts_incentives", 3, r"\b(send|give)\s+you\s+(money|cash|paypal|crypto|gift\s*cards?)\b"),
    ("gifts_incentives", 2, r"\b(robux|v-?bucks|nitro|steam\s+card|xbox\s+card|playstation\s+card)\b"),
    ("gifts_incentives", 2, r"\bi('?ll| will)\s+(pick\s+you\s+up|drive\s+you|get\s+you\s+a\s+ride)\b"),
    ("gifts_incentives", 2, r"\bi('?ll| will)\s+get\s+you\s+(weed|alcohol|vape|cigarettes?)\b"),
    ("boundary_testing", 2, r"\bhave\s+you\s+ever\s+(kissed|dated|made\s+out)\b"),
    ("boundary_testing", 2, r"\bhave\s+you\s+had\s+your\s+first\s+(kiss|boyfriend|girlfriend)\b"),
    ("boundary_testing", 2, r"\bare\s+you\s+(a\s+)?virgin\b"),
    ("boundary_testing", 2, r"\bwhat'?s\s+your\s+body\s+count\b"),
    ("boundary_testing", 2, r"\bdo\s+you\s+like\s+(older\s+guys|older\s+girls|older\s+men|older\s+women)\b"),
    ("boundary_testing", 2, r"\bwould\s+you\s+date\s+someone\s+older\b"),
    ("boundary_testing", 1, r"\byou'?re\s+not\s+(a\s+)?little\s+(kid|child)\s+anymore\b"),
    ("sexual_escalation", 3, r"\b(send|show)\s+(me\s+)?something\s+(sexy|hot|spicy)\b"),
    ("sexual_escalation", 3, r"\bmake\s+me\s+(hard|wet)\b"),
    ("sexual_escalation", 3, r"\bturn\s+me\s+on\b"),
    ("sexual_escalation", 3, r"\blet'?s\s+(sext|trade\s+nudes)\b"),
    ("sexual_escalation", 2, r"\blet'?s\s+(roleplay|rp)\b"),
    ("sexual_escalation", 2, r"\bdirty\s+talk\b"),
    ("sexual_escalation", 2, r"\bwhat\s+are\s+you\s+wearing\b"),
    ("sexual_escalation", 2, r"\brate\s+my\s+(body|pic|photo)\b"),
    ("body_focus", 3, r"\bshow\s+me\s+your\s+(body|chest|butt|ass|legs|stomach|tummy)\b"),
    ("body_focus", 3, r"\bsend\s+(me\s+)?(a\s+)?(body\s+pic|full\s+body\s+pic|mirror\s+selfie)\b"),
    ("body_focus", 2, r"\bstand\s+up\s+so\s+i\s+can\s+see\s+you\b"),
    ("body_focus", 2, r"\bturn\s+around\s+for\s+me\b"),
    ("body_focus", 2, r"\blift\s+your\s+(shirt|top)\b"),
    ("body_focus", 2, r"\bshow\s+me\s+your\s+outfit\b"),
    ("live_video_pressure", 3, r"\bturn\s+on\s+your\s+(camera|cam|webcam)\b"),
    ("live_video_pressure", 3, r"\bvideo\s+call\s+me\s+(alone|privately|now)\b"),
    ("live_video_pressure", 2, r"\blet'?s\s+(facetime|video\s+chat|cam)\b"),
    ("live_video_pressure", 2, r"\bgo\s+live\s+for\s+me\b"),
    ("live_video_pressure", 2, r"\bcan\s+i\s+watch\s+you\b"),
    ("live_video_pressure", 2, r"\bmove\s+the\s+camera\s+(down|lower|closer)\b"),
    ("reciprocal_image_pressure", 3, r"\bi('?ll| will)\s+send\s+(one|mine|first)\s+if\s+you\s+send\s+(one|yours)\b"),
    ("reciprocal_image_pressure", 3, r"\byour\s+turn\s+(now\s+)?to\s+send\b"),
    ("reciprocal_image_pressure", 3, r"\bi\s+showed\s+you\s+mine\b"),
    ("reciprocal_image_pressure", 3, r"\bprove\s+(it|you\s+trust\s+me)\s+with\s+(a\s+)?(pic|photo|snap|selfie)\b"),
    ("reciprocal_image_pressure", 2, r"\bjust\s+one\s+(pic|photo|snap|selfie)\b"),
    ("reciprocal_image_pressure", 2, r"\bi\s+promise\s+i('?ll| will)\s+delete\s+it\b"),
    ("sextortion", 3, r"\bi\s+(have|saved|recorded|screenshotted)\s+(your\s+)?(pics?|photos?|videos?|nudes?)\b"),
    ("sextortion", 3, r"\bi('?ll| will)\s+(post|leak|share|send)\s+(them|it|your\s+\w+)\b"),
    ("sextortion", 3, r"\b(send\s+more|do\s+what\s+i\s+say)\s+or\s+i('?ll| will)\b"),
    ("sextortion", 3, r"\bi\s+know\s+your\s+(school|parents?|friends?|address)\b"),
    ("sextortion", 3, r"\bpay\s+me\s+or\s+i('?ll| will)\s+(post|leak|send|share)\b"),
    ("sextortion", 3, r"\bdon'?t\s+block\s+me\s+or\s+i('?ll| will)\b"),
    ("age_gap_minimization", 2, r"\bage\s+(is\s+)?just\s+a\s+number\b"),
    ("age_gap_minimization", 2, r"\bdon'?t\s+worry\s+about\s+my\s+age\b"),
    ("age_gap_minimization", 2, r"\byou'?re\s+basically\s+an\s+adult\b"),
    ("age_gap_minimization", 2, r"\byou'?re\s+mature\s+enough\b"),
    ("age_gap_minimization", 2, r"\bnobody\s+has\s+to\s+know\s+how\s+old\s+we\s+are\b"),
    ("dependency_building", 2, r"\bi\s+understand\s+you\s+better\s+than\s+(your\s+)?(parents?|family|friends?)\b"),
    ("dependency_building", 2, r"\bthey\s+don'?t\s+understand\s+you\s+like\s+i\s+do\b"),
    ("dependency_building", 2, r"\bi('?m| am)\s+the\s+only\s+one\s+who\s+(cares|gets\s+you|understands)\b"),
    ("dependency_building", 2, r"\byou\s+need\s+me\b"),
    ("dependency_building", 2, r"\byou\s+can'?t\s+trust\s+(your\s+)?(parents?|family|friends?)\b"),
    ("offline_evasion", 3, r"\bsneak\s+out\b"),
    ("offline_evasion", 3, r"\bdon'?t\s+tell\s+anyone\s+where\s+you'?re\s+going\b"),
    ("offline_evasion", 3, r"\bcome\s+alone\b"),
    ("offline_evasion", 3, r"\bbring\s+(no\s+one|nobody)\b"),
    ("offline_evasion", 3, r"\bi('?ll| will)\s+pick\s+you\s+up\s+(after\s+school|tonight|tomorrow)\b"),
    ("offline_evasion", 2, r"\bmeet\s+me\s+(behind|near|outside)\s+(the\s+)?(school|mall|park|station)\b"),
    ("account_evasion", 3, r"\bmake\s+(a\s+)?(secret|private|new|alt|burner)\s+account\b"),
    ("account_evasion", 3, r"\bdon'?t\s+use\s+your\s+main\s+account\b"),
    ("account_evasion", 2, r"\bhide\s+(this|our\s+chat|the\s+app)\b"),
    ("account_evasion", 2, r"\bchange\s+my\s+name\s+in\s+your\s+phone\b"),
    ("account_evasion", 2, r"\bdelete\s+my\s+contact\b"),
    ("account_evasion", 2, r"\bclear\s+your\s+(history|notifications|recent\s+apps)\b"),
]

# ---------------------------------------------------------------------------
# Category weights, co-occurring pairs with their bonus, category groups.
# ---------------------------------------------------------------------------
CATEGORY_WEIGHTS: dict[str, float] = {
    "sexual_content": 3.0,
    "sexual_escalation": 3.0,
    "sextortion": 3.0,
    "image_solicitation": 2.5,
    "body_focus": 2.5,
    "reciprocal_image_pressure": 2.5,
    "live_video_pressure": 2.0,
    "isolation": 2.0,
    "offline_evasion": 2.0,
    "coercion": 2.0,
    "account_evasion": 1.5,
    "platform_migration": 1.5,
    "supervision_probe": 1.5,
    "meeting": 1.5,
    "contact_info_probe": 1.5,
    "gifts_incentives": 1.5,
    "boundary_testing": 1.0,
    "age_gap_minimization": 1.0,
    "dependency_building": 1.0,
    "routine_probe": 1.0,
    "rapid_intimacy": 1.0,
    "age_probing": 0.5,
}
DEFAULT_WEIGHT = 1.0
COUNT_CAP = 3

PAIR_BONUSES: list[tuple[str, str, float]] = [
    ("coercion", "sexual_content", 2.0),
    ("coercion", "sexual_escalation", 2.0),
    ("coercion", "image_solicitation", 1.5),
    ("sextortion", "image_solicitation", 2.0),
    ("sextortion", "coercion", 2.0),
    ("isolation", "sexual_content", 1.5),
    ("isolation", "image_solicitation", 1.5),
    ("meeting", "supervision_probe", 1.5),
    ("meeting", "offline_evasion", 2.0),
    ("contact_info_probe", "meeting", 1.5),
    ("gifts_incentives", "image_solicitation", 1.5),
    ("platform_migration", "sexual_content", 1.5),
    ("dependency_building", "image_solicitation", 1.5),
    ("dependency_building", "isolation", 1.5),
    ("boundary_testing", "sexual_escalation", 2.0),
    ("boundary_testing", "image_solicitation", 1.5),
    ("rapid_intimacy", "image_solicitation", 1.5),
    ("rapid_intimacy", "sexual_content", 2.0),
    ("gifts_incentives", "supervision_probe", 1.5),
    ("account_evasion", "image_solicitation", 1.5),
    ("account_evasion", "sexual_content", 1.5),
]

TRUST = [
    "rapid_intimacy", "dependency_building", "age_gap_minimization",
    "boundary_testing", "gifts_incentives",
]
SOLICIT = [
    "image_solicitation", "sexual_content", "sexual_escalation",
    "body_focus", "sextortion", "reciprocal_image_pressure",
]
CONTROL = [
    "coercion", "isolation", "account_evasion", "offline_evasion",
    "supervision_probe", "platform_migration",
]

# ---------------------------------------------------------------------------
# Scalars of the conversation score and of the contact window.
# ---------------------------------------------------------------------------
RISK_HIGH = 6.0
RISK_MEDIUM = 2.5
ESCALATION_BONUS = 3.0
ESCALATION_JUMP_BONUS = 1.5
ARC_BONUS = 2.5
ARC_CONTROL_BONUS = 1.0
RUN_BONUS = 0.5
RUN_LENGTH = 3
DOMINANCE_BONUS = 1.5
DOMINANCE_SHARE = 0.60
DENSITY_BONUS = 2.0
DENSITY_LIMIT = 1.5
ESCALATION_MIN_MESSAGES = 4
ARC_MIN_MESSAGES = 6

WINDOW_SIZE = 30
THETA_HIGH = 0.80
THETA_MEDIUM = 0.60
HIGH_COUNT = 3
RISKY_COUNT = 5

VAL_RATIO = 0.1
SEED = 42
BETA = 2.0

# ---------------------------------------------------------------------------
# Slang, whole words, applied after masking, in this order.
# ---------------------------------------------------------------------------
SLANG: list[tuple[str, str]] = [
    ("u", "you"),
    ("ur", "your"),
    ("r", "are"),
    ("y", "why"),
    ("pls", "please"),
    ("plz", "please"),
    ("thx", "thanks"),
    ("thanx", "thanks"),
    ("ty", "thank you"),
    ("np", "no problem"),
    ("sry", "sorry"),
    ("srry", "sorry"),
    ("idk", "i do not know"),
    ("ikr", "i know right"),
    ("imo", "in my opinion"),
    ("imho", "in my humble opinion"),
    ("ngl", "not gonna lie"),
    ("tbh", "to be honest"),
    ("nvm", "never mind"),
    ("smh", "shaking my head"),
    ("fyi", "for your information"),
    ("lol", "laughing out loud"),
    ("lmao", "laughing my ass off"),
    ("rofl", "rolling on the floor laughing"),
    ("omg", "oh my god"),
    ("omw", "on my way"),
    ("brb", "be right back"),
    ("gtg", "got to go"),
    ("g2g", "got to go"),
    ("ttyl", "talk to you later"),
    ("cya", "see you"),
    ("cu", "see you"),
    ("wb", "welcome back"),
    ("afk", "away from keyboard"),
    ("btw", "by the way"),
    ("afaik", "as far as i know"),
    ("asap", "as soon as possible"),
    ("irl", "in real life"),
    ("idc", "i do not care"),
    ("bf", "boyfriend"),
    ("gf", "girlfriend"),
    ("bff", "best friend forever"),
    ("crush", "romantic interest"),
    ("ima", "i am going to"),
    ("imma", "i am going to"),
    ("gonna", "going to"),
    ("wanna", "want to"),
    ("gotta", "got to"),
    ("lemme", "let me"),
    ("gimme", "give me"),
    ("kinda", "kind of"),
    ("sorta", "sort of"),
    ("outta", "out of"),
    ("cuz", "because"),
    ("coz", "because"),
    ("cause", "because"),
    ("wyd", "what are you doing"),
    ("hmu", "hit me up"),
    ("wbu", "what about you"),
    ("hbu", "how about you"),
    ("wydrn", "what are you doing right now"),
    ("rn", "right now"),
    ("tmr", "tomorrow"),
    ("tmrw", "tomorrow"),
    ("tonite", "tonight"),
    ("l8r", "later"),
    ("gr8", "great"),
    ("m8", "mate"),
    ("asl", "age sex location"),
    ("pic", "picture"),
    ("pics", "pictures"),
    ("vid", "video"),
    ("vids", "videos"),
    ("dm", "direct message"),
    ("dms", "direct messages"),
    ("pm", "private message"),
    ("pms", "private messages"),
    ("fr", "for real"),
    ("frfr", "for real for real"),
    ("noob", "newbie"),
    ("n00b", "newbie"),
    ("ppl", "people"),
    ("peeps", "people"),
    ("sup", "what is up"),
    ("wat", "what"),
    ("wut", "what"),
    ("tho", "though"),
    ("thru", "through"),
    ("kk", "okay"),
    ("okay", "okay"),
    ("ok", "okay"),
    ("k", "okay"),
    ("yeah", "yes"),
    ("ye", "yes"),
    ("yep", "yes"),
    ("yup", "yes"),
    ("nah", "no"),
    ("nope", "no"),
    ("ily", "i love you"),
    ("ilysm", "i love you so much"),
    ("ilu", "i love you"),
    ("xoxo", "hugs and kisses"),
    ("jk", "just kidding"),
    ("jkng", "just kidding"),
    ("jw", "just wondering"),
    ("n1", "nice one"),
    ("gg", "good game"),
    ("wp", "well played"),
]

# ---------------------------------------------------------------------------
# Masking patterns and the tokens of the annotated text.
# ---------------------------------------------------------------------------
URL_PATTERN = r"https?://\S+|www\.\S+"
EMAIL_PATTERN = r"\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b"
PHONE_PATTERN = r"\b\d[\d\s\-]{5,13}\d\b"
SEPARATOR = " [SEP] "
