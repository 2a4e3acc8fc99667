"""Views over the shared tables that several queries start from."""

from __future__ import annotations

from threadlens.plans.dialect import Dialect

#: Letters, marks and digits outside of ASCII.
OTHER_LETTERS = r"[^\x00-\x7F\pP\pS\pZ]"

#: The prose of the tables holds none of the domain's words, so queries on cues put one of these, by hash, before each turn's text.
PHRASES = [
    "thanks, that worked", "still not working for me", "please dm us your details", "try to restart the console and sign in again",
    "it doesn't work at all", "my account was hacked", "i want a refund now", "charged twice for my order", "i tried to reset it, no luck",
    "this is pathetic and useless", "for weeks now and no one replied", "i will sue, call my lawyer", "someone else is using my gamertag",
    "how do i redeem a code", "the controller and hdmi screen are broken", "the app crashes with error code 5", "can i connect online to the servers",
    "download and install the update", "banned for no reason, enforcement", "ok", "nice game yesterday", "hope it works soon",
    "none of these worked", "all good, resolved", "check www.example.com/help for steps", "it costs $20 to replace", "send us a note via direct message",
    "go to settings and clear the cache", "our chat team can help, submit a ticket", "when you tried that, what happened?",
    "it is still happening again", "stolen money, phishing fraud", "thank you so much", "where is my pre-order delivery", "what is the price",
    "the repair is under warranty", "unplug it, then power cycle", "no idea what this is", "update the app and log out", "see https://example.com/a.",
]


def messages(d: Dialect) -> str:
    """m: tweet_id, parent, conv_id, turn, role, inbound, author, created (minutes), text."""
    return """m AS (
        SELECT c.conv_id * 1000 + c.turn AS tweet_id, CASE WHEN c.turn > 0 THEN c.conv_id * 1000 + c.turn - 1 END AS parent,
               c.conv_id, c.turn, c.role, c.role = 'user' AS inbound,
               CASE WHEN c.role = 'user' THEN concat('u', CAST(c.conv_id % 37 AS STRING)) ELSE 'brand' END AS author,
               c.conv_id * 60 + c.turn * 7 AS created, c.text
        FROM conversations c)"""


def enriched(d: Dialect) -> str:
    """e: messages with their words, a phrase, then the turn's own text, as phrase and raw. The checking engine's word boundaries know ASCII
    alone, so in phrase it sees other letters as underscores, which are of words too."""
    rows = ", ".join(f"({i}, {d.lit(p)})" for i, p in enumerate(PHRASES))
    pick = d.hash32("concat(CAST(m.conv_id AS STRING), ':', CAST(m.turn AS STRING))")
    raw = "concat(ph.phrase, ' ', coalesce(m.text, ''))"
    words = raw if d.spark else d.sub(raw, OTHER_LETTERS, "_")
    return f"""{messages(d)}, ph AS (SELECT * FROM (VALUES {rows}) AS v(i, phrase)),
        e AS (SELECT m.*, {words} AS phrase, {raw} AS raw FROM m JOIN ph ON ph.i = {pick} % {len(PHRASES)})"""


def lines(d: Dialect) -> str:
    """l: each line of a turn as a message: the first answers the last line of the turn before, others the line before."""
    pieces = "posexplode(split(text, '\\n'))" if d.spark else "unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos"
    pos = f"SELECT conv_id, turn, role, {pieces} AS (pos, text) FROM conversations" if d.spark else f"SELECT conv_id, turn, role, {pieces} FROM conversations"
    return f"""s AS ({pos}), t AS (SELECT conv_id, turn, max(pos) AS top FROM s GROUP BY conv_id, turn),
        l AS (SELECT s.conv_id * 100000 + s.turn * 1000 + s.pos AS tweet_id,
                     CASE WHEN s.pos > 0 THEN s.conv_id * 100000 + s.turn * 1000 + s.pos - 1
                          WHEN t.top IS NOT NULL THEN t.conv_id * 100000 + t.turn * 1000 + t.top END AS parent,
                     s.conv_id, s.role = 'user' AS inbound, s.role AS author,
                     s.conv_id * 60 + s.turn * 7 + s.pos AS created, s.text
              FROM s LEFT JOIN t ON t.conv_id = s.conv_id AND t.turn = s.turn - 1)"""


def spoken(d: Dialect) -> str:
    """k: lines with a phrase, by a hash of their id, before each line's own text. Other letters as in ``enriched``."""
    rows = ", ".join(f"({i}, {d.lit(p)})" for i, p in enumerate(PHRASES))
    raw = "concat(ph.phrase, ' ', coalesce(l.text, ''))"
    words = raw if d.spark else d.sub(raw, OTHER_LETTERS, "_")
    return f"""{lines(d)}, ph AS (SELECT * FROM (VALUES {rows}) AS v(i, phrase)),
        k AS (SELECT l.tweet_id, l.parent, l.conv_id, l.inbound, l.author, l.created, {words} AS text, {raw} AS raw
              FROM l JOIN ph ON ph.i = {d.hash32("CAST(l.tweet_id AS STRING)")} % {len(PHRASES)})"""
