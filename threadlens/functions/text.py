"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, from here to the functions: the pattern library, one pattern a name. All but STEPS_FAILED work in Java and RE2 alike.
URL = r"https?://\S+"
MENTION = r"@\w+"
DM_REDIRECT = r"\b(?:dm|dms|dm'd|d\.m|direct messages?|private messages?|pm us|message us|send us a (?:note|message)|reach out (?:to us )?(?:via|in|through|by) (?:dm|direct|private))\b"
ACTION = r"\b(?:restart|restarting|reboot|re-?install|uninstall|update|updating|sign (?:out|in)|sign back in|log ?(?:out|in)|logging (?:out|in)|clear (?:the |your )?(?:cache|data|cookies|history)|settings|go to|tap|toggle|turn (?:it )?(?:off|on)|reset|resetting|force (?:quit|close|stop)|power cycle|unplug|delete (?:the )?app|remove|try|tried|make sure|check (?:that|if)|steps|enable|disable|head to|navigate|open the|should (?:now )?be (?:able|working|fixed)|you can (?:find|change|set|use|add|cancel|manage|vote|check))\b"
SIGNOFF = r"(?:[\^\*/] ?[a-z]{1,15}(?: [a-z]{1,15})?|[-–~] ?[a-z]{2,15})\s*$"
HANDOFF = r"\b(?:chat team|live chat|chat support|chat with (?:our|the)|support team|phone support|give us a call|call (?:our|the) \w+ team|reach out to (?:the |our |your )?(?:chat|phone|support|developer|publisher|maker|bank|isp|it department|game studio)\w*|contact (?:the |our |your )?(?:chat|support|developer|publisher|bank|isp)\w*|submit a (?:case|ticket|request)|case review)\b"
POLICY = r"\b(?:enforcement|code of conduct|terms of use|suspension|banned|ban)\b"
POSITIVE = r"\b(?:thanks|thank you|thx|ty|cheers|appreciate it|worked|works now|working now|fixed|sorted|resolved|solved|perfect|awesome|that did it|all good)\b"
NEGATIVE = r"\b(?:still|not working|doesn't work|didn't work|does not work|did not work|won't|same (?:issue|problem)|(?:happened|happening|doing it|did it|broke|broken) again|already (?:tried|did|done)|no luck|useless|ridiculous|worst|terrible|no response|no reply|nobody|never)\b"
FIX_CONFIRMED = r"\b(?:worked|it works|works now|working now|fixed|sorted|resolved|solved|that did it|did the trick|all good)\b"
FIX_NEGATED = r"(?:nothing|none|not|n't|didnt|dont|hope\w*|see if|if it|if that)\W+(?:\w+\W+){0,3}(?:work\w*|fix\w*|resolv\w*|sort\w*|solv\w*)"
ANGER = r"\b(?:fuck\w*|shit\w*|wtf|bullshit|crap|ridiculous|pathetic|worst|terrible|awful|useless|garbage|trash|scam\w*|pissed|furious|angry|disgusting|joke)\b"
LEGAL = r"\b(?:sue|suing|lawyer|attorney|legal action|lawsuit|court|bbb|better business bureau|trading standards)\b"
SECURITY = r"\b(?:hack\w*|stolen|compromised|fraud\w*|unauthori[sz]ed|phishing|scammed|someone (?:else )?(?:is |has been |keeps )?(?:using|signed|signing|logged|logging|getting) (?:in|into|on))\b"
BILLING_DISPUTE = r"\b(?:refund\w*|charged (?:twice|me|again|for)|double charged|overcharged|chargeback|money back|unauthori[sz]ed (?:charge|purchase)|billed)\b"
REPEAT_CONTACT = r"\b(?:again|still|already (?:tried|called|contacted|did|done|sent)|(?:second|third|fourth) time|for (?:days|weeks|hours|months)|(?:days|weeks) now|no one (?:has )?(?:responded|replied|helped|answered)|still waiting)\b"
CUSTOMER_ATTEMPT = r"\b(?:steps you(?:'ve| have)? tried|(?:when|if|as|while|whenever) you (?:try|tried)|you(?:'ve| have)? (?:already )?tried)\b"
DM_ASK = r"\b(?:dm|direct message|private message|message us|pm us)\b"
TRIED = r"\b(?:tried|already\s+(?:tried|did|done)|i(?:'ve|\s+have)\s+(?:tried|done)|didn'?t\s+work|doesn'?t\s+work|no\s+luck|still\s+(?:not|doesn'?t|won'?t))\b"
CLOSING = r"\b(?:thanks|thank you|cheers|ta\b|appreciate it|it works|working now|fixed|sorted|all good|resolved)\b"
QUESTION = r"\?|\b(?:how|what|when|why|where|can i|do i|is there|will there)\b"
DM_LOGISTICS = r"\b(?:dm|dms|dm'd|messaged|sent you|sent it|sent a|just sent)\b"
SPLIT = r"(?:\b[1-4]/[2-4]\b|^(?:@\w+ )+[1-4]: |\s[1-4]\s*$)"
PART_END = r"\s([1-4])(?:/[2-4])?\s*(?:\^\s?\w{1,3})?\s*(?:https?://\S+\s*)*$"
PART_START = r"^(?:@\w+\s+)+([1-4])(?::|/[2-4])"
LINK = r"https?://[^\s<>\"')]+|\bwww\.[^\s<>\"')]+"
AMOUNT = r"[$£€]\s?\d+(?:[.,]\d+)?|\b\d+(?:[.,]\d+)?\s?(?:usd|gbp|eur|dollars|pounds)\b"
CHECK_INBOX = r"\bcheck\s+your\s+(?:dms?|messages|inbox)\b"
DM_CLAUSE = r"\b(?:please\s+)?(?:send\s+us\s+a\s+|shoot\s+us\s+a\s+)?(?:dm|direct message|private message|pm)\s*(?:us|me)?\b[^.!?]*"
BRAND_ASKS = r"(?:\?)|\b(?:can|could|would)\s+you\s+(?:dm|send|share|tell|let\s+us\s+know|provide)\b|\b(?:please\s+)?(?:dm|send)\s+us\b|\bwhat\s+(?:is|are|error)\b"
SAMPLE_ACCOUNT = r"\b(?:account|sign(?:ed)? ?in|log ?in|password|e-?mail|gamertag|hacked|recover\w*)\b"
SAMPLE_REPAIR = r"\b(?:repair\w*|replace\w*|warranty|broken|won'?t turn on|dead|no signal|disc drive|overheat\w*)\b"
#: The cues of a customer's own words, as the codebook defines them; case doesn't matter. The alternatives of a cue are listed.
STEPS_FAILED = [
    r"\b(?:i\s*(?:'ve|\s+have)?\s*)?(?:already\s+)?(?:tried|did|done|followed|attempted)\b(?![^.!?]{0,40}\bnot\b)",
    r"\bdidn'?t\s+(?:work|help|fix|do\s+anything)\b",
    r"\bdoes(?:n'?t|\s+not)\s+(?:work|help|fix)\b",
    r"\bstill\s+(?:not\s+working|doesn'?t|does\s+not|won'?t|wont|no\b|the\s+same|happening|same\s+(?:thing|issue|error|problem)|nothing)",
    r"\bstill\s+(?:it\s+)?(?:would|would'?nt|wouldn'?t|didn'?t)\b",
    r"\bnothing\s+(?:works|worked|helped|helps|has\s+helped|suggested)\b",
    r"\b(?:no\s+luck|to\s+no\s+avail|without\s+success|same\s+(?:issue|problem|error)\s+again)\b",
    r"\beven\s+after\s+(?:a\s+)?(?:reset|restart|reinstall|factory)",
    r"\bafter\s+(?:a\s+)?(?:reset|factory\s+reset|reinstall|re-?download)\b",
    r"\bre-?(?:downloaded|installed|set)\b[^.!?]{0,40}\b(?:still|persists?|again)\b",
]
CUES = {
    "steps_failed": STEPS_FAILED,
    "repeat_contact": [
        r"\b(?:already\s+)?(?:contacted|called|phoned|emailed|e-?mailed|messaged|chatted|spoke|spoken|talked|reached\s+out)\b[^.!?]{0,40}\b(?:support|team|agent|you|xbox|microsoft|chat|phone)\b",
        r"\b(?:sent|send|dm'?d|dmed)\s+(?:you\s+)?(?:a\s+|an\s+)?(?:dm|direct\s+message|email|message)\b",
        r"\b(?:chat|phone|support)\s+(?:team|agent|session|support)\b",
        r"\b(?:tried|trying)\s+to\s+(?:chat|call|contact|reach)\b",
        r"\b(?:still\s+waiting|no\s+(?:response|reply|answer)|never\s+(?:replied|responded|got\s+back)|haven'?t\s+heard\s+back|chased)\b",
        r"\b(?:in\s+case\s+you\s+(?:didn'?t|did\s+not)\s+see|second\s+time|third\s+time|again\s+and\s+again|for\s+(?:the\s+)?(?:second|third|fourth)\s+time)\b",
        r"\b(?:for|over|past)\s+\d+\s+(?:days?|weeks?|months?)\b",
        r"\b(?:every\s+day|days?\s+now|weeks?\s+now)\b",
    ],
    "strong_anger": [
        r"\b(?:fuck\w*|shit\w*|bullshit|bloody|crap\w*|damn|arse|ass\b)\b",
        r"\b(?:pathetic|useless|garbage|rubbish|disgrace\w*|appalling|atrocious|incompetent|(?:a\s+)?(?:complete|absolute|total)\s+joke|joke\b|clowns?\b|scam\w*)\b",
        r"\b(?:switch(?:ing)?|mov(?:e|ing)|go(?:ing)?|buy(?:ing)?)\s+(?:back\s+)?to\s+(?:a\s+)?(?:ps\s?\d|playstation|sony|nintendo)\b",
        r"\b(?:never\s+buying|done\s+with\s+xbox|cancel(?:ling|ing)?\s+my\s+(?:gold|game\s?pass|subscription))\b",
    ],
    "money_dispute": [
        r"\b(?:charged|billed)\s+(?:me\s+)?(?:twice|again|multiple|two\s+times|without)\b",
        r"\bdouble[-\s]?charg\w*\b",
        r"\b(?:took|taken|stole|stolen)\s+my\s+money\b",
        r"\brefund\s+(?:was\s+)?(?:refused|denied|declined|rejected)\b",
        r"\b(?:denied|refused)\s+(?:me\s+)?(?:the\s+|a\s+|my\s+)?refund\b",
        r"\b(?:unauthori[sz]ed|unknown|unexpected)\s+(?:charge|payment|transaction)\b",
        r"\b(?:my\s+money\s+back|hold\s+on\s+my\s+(?:cc|card|credit))\b",
    ],
    "account_compromised": [
        r"\b(?:hack\w*|compromis\w*|stolen\s+(?:account|gamertag)|breach\w*)\b",
        r"\b(?:someone|somebody)\s+(?:else\s+)?(?:has|is|got|took|logged|signed|accessed|changed|using)\b",
        r"\b(?:unauthori[sz]ed|unknown)\s+(?:access|sign[-\s]?ins?|logins?|ip)\b",
        r"\b(?:other\s+)?ip'?s?\s+(?:accessing|logging|on)\b",
        r"\baccessing\s+my\s+(?:account|stuff|profile)\b",
    ],
    "harm_or_legal": [
        r"\b(?:lawyer|solicitor|attorney|legal\s+action|sue\b|suing|court|police|trading\s+standards|ombudsman|regulator|small\s+claims)\b",
        r"\b(?:kill|hurt|harm)\s+(?:myself|himself|herself|themselves)\b",
        r"\b(?:doxx?\w*|address\s+posted|threaten\w*\s+(?:me|my\s+family))\b",
        r"\b(?:my\s+)?(?:son|daughter|child|kid)\b[^.!?]{0,40}\b(?:groom\w*|predator|unsafe|inappropriate)\b",
    ],
    "repair_or_replacement": [
        r"\b(?:repair\w*|replac\w*|warrant\w*|servic(?:e|ed|ing)|rma\b)\b",
        r"\b(?:fixable|get\s+it\s+fixed|send\s+it\s+(?:in|back)|new\s+(?:console|controller|cable|unit))\b",
        r"\b(?:needs?\s+(?:servicing|repairing|replacing)|broken\s+beyond)\b",
    ],
    "account_specific_action": [
        r"\bmy\s+(?:account|gamertag|profile|order|pre-?order|subscription|membership|licen[cs]e|code|purchase|billing|card|cc\b)\b",
        r"\b(?:gamertag|gt)\s*(?:is|:)\s*\S+",
        r"\b(?:check|look\s+(?:in)?to|investigate|verify|reset|restore|refund|cancel|change)\s+(?:my|the)\s+(?:account|order|gamertag|subscription|purchase|code)\b",
        r"\b(?:request|need|want)\s+(?:a\s+)?(?:new|replacement)\s+(?:cable|controller|console|code)\b",
        r"\bhow\s+do\s+(?:i|you)\s+refund\b",
        r"\b(?:havent|haven'?t|still\s+not)\s+(?:got|received)\s+my\b",
    ],
}
#: The older, weaker cues of the keyword baseline.
LEGACY_CUES = {
    "strong_anger": r"\b(?:fuck\w*|shit|bullshit|crap|useless|pathetic|joke|garbage|ridiculous)\b|\b(?:switch(?:ing)? to|buy(?:ing)? a) (?:ps\d|playstation)\b",
    "repeat_contact": r"\b(?:already (?:contacted|called|chatted|emailed|spoke)|still waiting|third time|again and again|no(?:-| )?one (?:has )?(?:replied|responded|helped)|chat(?:ted)? (?:with )?support|phone team|customer service)\b",
    "steps_failed": r"\b(?:(?:i(?:'ve| have)? )?(?:tried|did) (?:that|this|everything|all)|didn'?t work|does(?:n'?t| not) work|still (?:not working|doesn'?t|won'?t|happening|same)|nothing (?:works|helped|suggested)|no luck|to no avail)\b",
    "account_specific_action": r"\b(?:my (?:account|gamertag|profile|order|subscription)|gamertag is|my gt\b|change my|on my account)\b",
    "repair_or_replacement": r"\b(?:repair\w*|replace\w*|warranty|servic(?:e|ing)|rma|fixable|send it (?:in|back))\b",
    "account_compromised": r"\b(?:hack\w*|compromis\w*|unauthori[sz]ed|someone (?:else )?(?:has|is using|logged|changed)|stolen)\b",
    "harm_or_legal": r"\b(?:lawyer|solicitor|legal action|sue|police|trading standards|ombudsman|kill myself|threat(?:en)?(?:ed|ing)? (?:me|to))\b",
    "money_dispute": r"\b(?:charged (?:twice|again|without)|double charged|took my money|refund (?:refused|denied)|stole my money|unauthori[sz]ed charge|my money back)\b",
}
#: Intents of the keyword baseline; the first that matches counts.
INTENTS = {
    "enforcement_safety": r"\b(?:bann?(?:ed|ing)?|suspen\w*|enforcement|code of conduct|reported (?:me|a|him|her|them)|gamerpic|harass\w*|cheat\w*)\b",
    "purchases_billing_orders": r"\b(?:refund\w*|charg(?:e|ed|ing)|payment|billing|invoice|credit card|paypal|pre-?order\w*|delivery|shipped|price|money)\b",
    "entitlements_subscriptions_codes": r"\b(?:codes?|redeem\w*|gift ?card|game ?pass|gold|subscription|season pass|dlc|licen[cs]e|trial|game sharing|home xbox)\b",
    "account_access_profile": r"\b(?:account|sign(?:ed|ing)? ?in|log ?in|password|e-?mail|gamertag|profile|child account|family settings)\b",
    "connectivity_xbox_live": r"\b(?:connect\w*|disconnect\w*|online|servers?|nat\b|lag\w*|party chat|matchmaking|xbox live (?:down|status)|network)\b",
    "install_download_update": r"\b(?:download\w*|install\w*|updat\w*|patch|storage|queue|re-?download)\b",
    "hardware_devices": r"\b(?:controller|console|disc drive|disc|hdmi|headset|kinect|power|overheat\w*|fan|hard ?drive|screen|turn on|won'?t start)\b",
    "software_game_app": r"\b(?:crash\w*|freez\w*|bug|glitch|error code|launch|achievement|app\b|dashboard|game won'?t)\b",
    "support_process_complaint": r"\b(?:no(?:-| )?one helps|still waiting|ignor\w*|support team|useless support)\b",
    "product_info_feedback": r"\b(?:how do i|can i|is there|does it|will it|when will|backwards? compat\w*|suggest\w*|feedback)\b",
}
#: Draft intents that sized the codebook; the first that matches counts.
DRAFT_INTENTS = {
    "enforcement_ban": r"\b(?:ban|banned|suspend|suspended|suspension|enforcement|reported me)\b",
    "purchase_billing_refund": r"\b(?:refund\w*|charged|charge|charges|billing|billed|payment|credit card|debit card|declined|money|price|purchase|purchasing|can't buy|cannot buy|unable to buy)\b",
    "code_redemption": r"\b(?:redeem\w*|redemption|gift ?cards?|vouchers?|dlc|tokens?|pre-?order bonus|(?:promo|download|digital|product|season pass|25 digit|25-digit) codes?|codes? (?:isn't|won't|not|doesn't|didn't|says|invalid))\b",
    "subscription_membership": r"\b(?:gold|game ?pass|membership|subscription|subscribe|renew|ea access)\b",
    "account_access_security": r"\b(?:hack|hacked|password|sign ?in|signed out|log ?in|login|account|email|gamertag|recovery|family|child)\b",
    "connectivity_online": r"\b(?:disconnect\w*|connection|connect|network|nat|wifi|wi-fi|internet|servers?|lag\w*|online|party|multiplayer|ping)\b",
    "download_install_update": r"\b(?:update\w*|download\w*|install\w*|storage|queue|stuck at)\b",
    "console_hardware_display": r"\b(?:turn on|turns? off|turning off|won't turn|power\w*|freez\w*|frozen|black screen|disc|disk|hdmi|overheat\w*|fan|4k|hdr|tv|display)\b",
    "controller_accessories": r"\b(?:controllers?|kinect|headset|mic|elite|battery|batteries|adapter|keyboard)\b",
    "game_app_bug": r"\b(?:crash\w*|bug\w*|glitch\w*|error\w*|won't load|won't launch|not loading|achievements?)\b",
    "info_feature_request": r"\b(?:when|release|coming|will there|is there|feature|backwards?|compatib\w*|suggestion|news|sale)\b",
}
EN_STOP = "the to my you your and for this that with have has can not why how what when just get got please thanks help been was are will would still any of is it on me i'm it's don't doesn't can't".split()
FOREIGN_STOP = "que por para los las el una pero muy estoy tengo gracias hola porque cuando est pas les des avec pour merci bonjour und nicht ist mit ich das der não você obrigado uma mais het een niet mijn".split()
FOREIGN_SCRIPT = "[Ѐ-ӿ؀-ۿ฀-๿぀-ヿ一-鿿가-힯]"
STEPS = ["restart", "reboot", "reinstall", "re-install", "unplug", "power cycle", "powercycle", "hard reset", "factory reset", "update", "sign out", "sign in", "log out", "log in", "clear cache", "reset", "power button", "disconnect", "reconnect", "recalibrat"]
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    """Named entities that occur in messages; &amp; last."""
    for entity, plain in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def template_key(lower: Column) -> Column:
    """A brand message without links, sign-off, handles, digits and punctuation."""
    text = F.trim(F.regexp_replace(lower, URL, " "))
    text = F.regexp_replace(F.regexp_replace(text, SIGNOFF, " "), MENTION, " ")
    return collapse(F.regexp_replace(text, "[^a-z' ]+", " "))


def language(lower: Column) -> Column:
    """en, other or undetermined, by counts of function words."""
    body = F.regexp_replace(F.regexp_replace(lower, URL, " "), MENTION, " ")
    word = lambda words: F.regexp_count(body, F.lit(r"(?U)\b(?:" + "|".join(words) + r")\b"))
    en, foreign = word(EN_STOP), word(FOREIGN_STOP)
    return (
        F.when(body.rlike(FOREIGN_SCRIPT) | (foreign > en), "other").when(en >= 1, "en").otherwise("undetermined")
    )


def clean_customer(text: Column) -> Column:
    text = F.regexp_replace(unescape(text), r"^(?:\s*@\w+)+\s*", "")
    return collapse(F.regexp_replace(F.regexp_replace(text, URL, "<URL>"), MENTION, "@user"))


def clean_brand_part(text: Column) -> Column:
    """One brand message: leading handles, agent sign-off and split markers removed, trailing links kept at the end."""
    signoff = r"(?i)(?:\s*\^ ?[a-z]{1,15}|\s+(?:[\*/] ?[a-z]{1,15}(?: [a-z]{1,15})?|[-–~] ?[a-z]{2,15}))\s*$"
    text = F.regexp_replace(F.regexp_replace(unescape(text), r"^(?:\s*@\w+)+\s*", ""), URL, "<URL>")
    tail = F.repeat(F.lit(" <URL>"), F.regexp_count(F.regexp_extract(text, r"((?:\s*<URL>)*)\s*$", 1), F.lit("<URL>")))
    body = F.regexp_replace(text, r"(?:\s*<URL>)+\s*$", "")
    for _ in range(2):
        body = F.regexp_replace(F.regexp_replace(body, signoff, ""), r"\s+[1-4](?:/[2-4])?\s*$", "")
    body = F.regexp_replace(F.trim(body), r"^[1-4](?::|/[2-4])\s+", "")
    return collapse(F.regexp_replace(F.concat(body, tail), MENTION, "@user"))


def has_guidance(reply: Column) -> Column:
    """Some sentence guides and doesn't ask for a direct message."""
    sentences = F.split(F.lower(reply), r"(?<=[.!?])\s+|<url>")
    clean = lambda s: F.regexp_replace(s, CUSTOMER_ATTEMPT, " ")
    return F.exists(sentences, lambda s: clean(s).rlike(ACTION) & ~clean(s).rlike(DM_REDIRECT))


def reply_type(reply: Column, canned: Column) -> Column:
    guides, dm = has_guidance(reply), F.lower(reply).rlike(DM_REDIRECT)
    return F.when(guides & ~canned, "substantive").when(dm & ~guides, "dm_deflection").otherwise("other")


def weak_outcome(next_text: Column, kind: Column) -> tuple[Column, Column]:
    """Outcome and confidence from the customer's next message and the reply's type."""
    text = F.lower(F.coalesce(next_text, F.lit("")))
    negated = text.rlike(NEGATIVE) | text.rlike(FIX_NEGATED)
    fixed, thanks = text.rlike(FIX_CONFIRMED) & ~negated, text.rlike(POSITIVE) & ~negated
    outcome = F.when(fixed, "resolved").when(negated, "unresolved").when(thanks, "acknowledged")
    sure = F.when(fixed & (kind == "substantive"), "medium").when(fixed, "low").when(negated, "medium").when(thanks, "low")
    deflected = kind == "dm_deflection"
    return outcome.when(deflected, "deflected").otherwise("unknown"), sure.when(deflected, "high").otherwise("none")


def normalise_url(url: Column) -> Column:
    url = F.lower(F.regexp_replace(url, r"[.,);:!?]+$", ""))
    for prefix in ("^https://", "^http://", r"^www\."):
        url = F.regexp_replace(url, prefix, "")
    return url


def steps_mentioned(text: Column) -> Column:
    """The canonical steps that a text contains, as substrings."""
    return F.filter(F.array(*map(F.lit, STEPS)), lambda s: F.contains(F.lower(F.coalesce(text, F.lit(""))), s))


def parse_wait(message: Column) -> Column:
    """Seconds of "try again in 1h2m3.5s"; null where there is no such text."""
    wait = F.regexp_extract(F.lower(message), r"try again in ((?:\d+h)?(?:\d+m)?(?:\d+(?:\.\d+)?s)?)", 1)
    part = lambda unit: F.coalesce(F.regexp_extract(wait, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(wait != "", 3600 * part("h") + 60 * part("m") + part("s"))


def part_number(text: Column) -> Column:
    """The number of a split message, at its end or behind leading handles; else 0."""
    found = (F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (PART_END, PART_START))
    return F.coalesce(*found, F.lit("0")).cast("int")


def first_of(text: Column, patterns: dict[str, str], default: str) -> tuple[Column, Column]:
    """The name of the first pattern that a text matches, and how many it matches."""
    hits = {k: text.rlike("(?i)" + p) for k, p in patterns.items()}
    first = F.coalesce(*(F.when(h, F.lit(k)) for k, h in hits.items()), F.lit(default))
    return first, sum((F.when(h, 1).otherwise(0) for h in hits.values()), F.lit(0))


def iso_minutes(at: Column) -> Column:
    """A timestamp as 2017-10-01T12:00Z, seconds cut off."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm"), F.lit("Z"))


def resolution(next_text: Column) -> Column:
    """What the customer's next message says of the outcome, in five ways."""
    low = F.lower(F.coalesce(next_text, F.lit("")))
    negated = low.rlike(NEGATIVE) | low.rlike(FIX_NEGATED)
    return (
        F.when(next_text.isNull(), "no_customer_answer").when(low.rlike(FIX_CONFIRMED) & ~negated, "fix_confirmed")
        .when(low.rlike(POSITIVE) & ~negated, "thanks_only").when(negated, "unresolved_cue").otherwise("other_answer")
    )


def first_reply_type(reply: Column, canned: Column) -> Column:
    """The reply's type by its words alone, sentences aside."""
    action, dm = F.lower(reply).rlike(ACTION), F.lower(reply).rlike(DM_REDIRECT)
    return F.when(action & ~canned, "substantive").when(dm & ~action, "dm_deflection").otherwise("other_reply")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """A 95 % interval for k of n, within 0 and 1; (0, 0) for n = 0."""
    p, zz = F.try_divide(k, n), z * z
    middle, width = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = F.greatest(F.lit(0.0), middle - width), F.least(F.lit(1.0), middle + width)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 0.0).otherwise(high)


def unit(vector: Column) -> Column:
    """A vector over its length; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(vector, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x / norm))


def cell(text: Column, most: int | None = None) -> Column:
    """Text for a cell of a report table: one line, bars escaped, cut at ``most`` characters."""
    text = F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    return text if most is None else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def odd_characters(text: Column) -> Column:
    """Characters outside printable ASCII and the tab, each as U+ with its code."""
    odd = F.regexp_extract_all(text, F.lit(r"([^\t\x20-\x7E])"), F.lit(1))
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 16)
    return F.transform(odd, lambda c: F.concat(F.lit("U+"), F.when(F.length(code(c)) < 4, F.lpad(code(c), 4, "0")).otherwise(code(c))))


def outer_json(text: Column) -> Column:
    """From the first { to the last }; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def rate_limit(message: Column, most: float = 1800.0) -> Column:
    """(kind, wait) of an error message that reports a rate limit: tokens_per_day or tokens_per_minute with the seconds to
    wait, a margin included; null otherwise."""
    low, wait = F.lower(message), parse_wait(message)
    daily = F.struct(F.lit("tokens_per_day").alias("kind"), (F.least(F.coalesce(wait, F.lit(900.0)), F.lit(most)) + 20).alias("wait"))
    minute = F.struct(F.lit("tokens_per_minute").alias("kind"), (F.least(F.coalesce(wait, F.lit(70.0)), F.lit(300.0)) + 5).alias("wait"))
    return F.when(low.contains("tokens per day"), daily).when(wait.isNotNull() | low.contains("rate limit"), minute)
