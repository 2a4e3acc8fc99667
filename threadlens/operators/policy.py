"""The escalation policy as expressions: risk, reasons, decision; and the checks of a drafted reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as T

# Intents with their default risk; intents answered by a fix, and always escalated; cues; reasons by priority.
RISKS = {
    "connectivity_xbox_live": "low", "install_download_update": "low", "hardware_devices": "medium", "software_game_app": "low",
    "account_access_profile": "medium", "purchases_billing_orders": "high", "entitlements_subscriptions_codes": "medium",
    "enforcement_safety": "medium", "product_info_feedback": "low", "support_process_complaint": "high", "needs_more_context": "low",
}
FIX = ["connectivity_xbox_live", "install_download_update", "hardware_devices", "software_game_app", "account_access_profile", "entitlements_subscriptions_codes"]
CUES = ["account_compromised", "harm_or_legal", "money_dispute", "steps_failed", "repeat_contact", "strong_anger", "account_specific_action", "repair_or_replacement", "prior_clarification"]
PRIORITY = ["SECURITY", "SAFETY_LEGAL", "BILLING_DISPUTE", "ACCOUNT_SPECIFIC", "REPEAT_CONTACT", "STEPS_FAILED", "HIGH_ANGER", "OUT_OF_SCOPE", "LOW_CONFIDENCE", "REPLY_FAILED_CHECKS"]


def default_risk(intent: Column) -> Column:
    return F.coalesce(*(F.when(intent == k, F.lit(v)) for k, v in RISKS.items()), F.lit("low"))


def risk_level(intent: Column, cue: dict[str, Column]) -> Column:
    """The higher of the intent's default risk and what fired cues ask for."""
    default = default_risk(intent)
    high = cue["account_compromised"] | cue["harm_or_legal"] | cue["money_dispute"]
    medium = cue["repeat_contact"] | cue["steps_failed"] | cue["strong_anger"]
    return F.when(high, "high").when((default == "low") & medium, "medium").otherwise(default)


def decide(intent: Column, cue: dict[str, Column], low_confidence: Column | None = None) -> Column:
    """struct<escalate, reason, risk, trigger, text>: all reasons that apply, the code of highest priority with the
    trigger of its first reason, and the distinct texts in order."""
    low_confidence = F.lit(False) if low_confidence is None else low_confidence
    purchases, complaint = intent == "purchases_billing_orders", intent == "support_process_complaint"
    hot = default_risk(intent) != "low"
    rules = [
        (cue["account_compromised"], "SECURITY", "account compromised", "rule"),
        (cue["harm_or_legal"], "SAFETY_LEGAL", "harm or legal threat", "rule"),
        (cue["money_dispute"], "BILLING_DISPUTE", "money dispute", "rule"),
        (purchases & cue["money_dispute"], "BILLING_DISPUTE", "purchases_billing_orders always escalates", "policy"),
        (purchases & ~cue["money_dispute"], "ACCOUNT_SPECIFIC", "purchases_billing_orders always escalates", "policy"),
        (complaint & cue["repeat_contact"], "REPEAT_CONTACT", "support_process_complaint always escalates", "policy"),
        (complaint & ~cue["repeat_contact"], "HIGH_ANGER", "support_process_complaint always escalates", "policy"),
        ((intent == "account_access_profile") & cue["account_specific_action"], "ACCOUNT_SPECIFIC", "needs the customer's own account", "policy"),
        ((intent == "entitlements_subscriptions_codes") & cue["account_specific_action"], "ACCOUNT_SPECIFIC", "a specific order, code or licence must be looked up", "policy"),
        ((intent == "hardware_devices") & cue["repair_or_replacement"], "ACCOUNT_SPECIFIC", "repair or replacement requested", "policy"),
        (cue["steps_failed"] & cue["repeat_contact"], "REPEAT_CONTACT", "repeat contact and the steps already failed", "rule"),
        (cue["steps_failed"] & ~cue["repeat_contact"], "STEPS_FAILED", "the steps already failed", "rule"),
        (cue["strong_anger"] & hot, "HIGH_ANGER", "strong anger", "rule"),
        ((intent == "needs_more_context") & cue["prior_clarification"], "LOW_CONFIDENCE", "still vague after a clarification", "policy"),
        (low_confidence, "LOW_CONFIDENCE", "classifier confidence below the dev threshold", "model"),
    ]
    fired = F.array_compact(
        F.array(*(
            F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(PRIORITY.index(code)).alias("p"), F.lit(i).alias("i"), F.lit(code).alias("code"), F.lit(said).alias("text"), F.lit(by).alias("by")))
            for i, (rule, code, said, by) in enumerate(rules)
        ))
    )
    first, any_ = F.array_min(fired), F.size(fired) > 0
    auto = F.when(intent.isin(FIX), "ROUTINE_TROUBLESHOOTING").otherwise("GENERAL_INFO")
    return F.struct(
        any_.alias("escalate"),
        F.when(any_, first["code"]).otherwise(auto).alias("reason"),
        risk_level(intent, cue).alias("risk"),
        F.when(any_, first["by"]).otherwise("policy").alias("trigger"),
        F.array_join(F.array_distinct(F.transform(fired, lambda x: x["text"])), "; ").alias("text"),
    )


# The policy in force and what its alternatives change; intents whose own policy escalates on failed steps.
STEPS_INTENTS = ["hardware_devices", "entitlements_subscriptions_codes"]
IN_FORCE = {"steps_alone": True, "steps_code": "STEPS_FAILED", "repeat_alone": False, "anger_at_low": False, "repair": True, "account_always": False, "clarify": True}
ALTERNATIVES = {
    "in_force": {},
    "anger_at_any_risk": {"anger_at_low": True},
    "repeat_alone": {"repeat_alone": True},
    "steps_need_repeat": {"steps_alone": False, "steps_code": "ACCOUNT_SPECIFIC"},
    "account_always": {"account_always": True},
    "clarify_again": {"clarify": False},
    "repair_after_steps": {"repair": False},
}


def alternatives(intent: Column, cue: dict[str, Column]) -> Column:
    """array<struct<policy, escalate, reason>>: the decision on a row under each policy of ALTERNATIVES, in order. All are read off
    one array of conditions that the row meets; a policy takes those that it knows, with its own codes."""
    hot = default_risk(intent) != "low"
    steps, repeat = cue["steps_failed"], cue["repeat_contact"]
    is_ = lambda name: intent == name
    # condition, code, the option that it needs and the value, code by option
    conditions = [
        (cue["account_compromised"], "SECURITY", None), (cue["harm_or_legal"], "SAFETY_LEGAL", None), (cue["money_dispute"], "BILLING_DISPUTE", None),
        (is_("purchases_billing_orders") & ~cue["money_dispute"], "ACCOUNT_SPECIFIC", None),
        (is_("support_process_complaint") & repeat, "REPEAT_CONTACT", None), (is_("support_process_complaint") & ~repeat, "HIGH_ANGER", None),
        (intent.isin("account_access_profile", "entitlements_subscriptions_codes") & cue["account_specific_action"], "ACCOUNT_SPECIFIC", None),
        (is_("account_access_profile"), "ACCOUNT_SPECIFIC", "account_always"),
        (is_("hardware_devices") & cue["repair_or_replacement"], "ACCOUNT_SPECIFIC", "repair"),
        (steps & repeat, "REPEAT_CONTACT", None), (steps & ~repeat, "steps_code", "steps_alone"),
        (steps & ~repeat & intent.isin(STEPS_INTENTS), "ACCOUNT_SPECIFIC", "not steps_alone"),
        (repeat, "REPEAT_CONTACT", "repeat_alone"), (cue["strong_anger"] & hot, "HIGH_ANGER", None), (cue["strong_anger"] & ~hot, "HIGH_ANGER", "anger_at_low"),
        (is_("needs_more_context") & cue["prior_clarification"], "LOW_CONFIDENCE", "clarify"),
    ]
    met = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, (c, _, _) in enumerate(conditions))))
    auto = F.when(intent.isin(FIX), "ROUTINE_TROUBLESHOOTING").otherwise("GENERAL_INFO")
    names = F.array(*map(F.lit, PRIORITY))

    def under(met: Column, name: str, changes: dict) -> Column:
        options = IN_FORCE | changes
        known = lambda o: o is None or (not options[o[4:]] if o.startswith("not ") else options[o])
        place = lambda code: PRIORITY.index(options.get(code, code))
        by = F.array(*(F.lit(place(code)) if known(o) else F.lit(None).cast("int") for _, code, o in conditions))
        first = F.array_min(F.transform(met, lambda i: F.get(by, i)))
        return F.struct(F.lit(name).alias("policy"), first.isNotNull().alias("escalate"), F.coalesce(F.get(names, first), auto).alias("reason"))

    return F.get(F.transform(F.array(met), lambda m: F.array(*(under(m, k, v) for k, v in ALTERNATIVES.items()))), 0)


def flips(rows: DataFrame, decisions: str = "decisions") -> DataFrame:
    """The rows with policy, escalate, reason, was: a row for each alternative that decides it other than the policy in force
    (its first decision), by escalation or reason; was: the reason in force."""
    each = rows.withColumn("_d", F.explode(F.slice(decisions, 2, len(ALTERNATIVES)))).withColumn("_f", F.get(decisions, 0))
    changed = (F.col("_d.escalate") != F.col("_f.escalate")) | (F.col("_d.reason") != F.col("_f.reason"))
    return each.filter(changed).select(*rows.drop(decisions).columns, "_d.policy", "_d.escalate", "_d.reason", F.col("_f.reason").alias("was"))


def draft_checks(draft: Column, said: Column, evidence: Column, most: int = 280) -> Column:
    """The checks that a drafted reply fails. said: the customer's own words; evidence: the conversation and retrieved
    examples, all of what the draft may rest on."""
    draft, low = F.trim(F.coalesce(draft, F.lit(""))), F.lower(F.trim(F.coalesce(draft, F.lit(""))))
    evidence = F.lower(evidence)
    links = lambda x: F.transform(F.regexp_extract_all(F.lower(x), F.lit(T.LINK), F.lit(0)), T.normalise_url)
    amounts = F.transform(F.regexp_extract_all(low, F.lit(T.AMOUNT), F.lit(0)), lambda m: F.replace(m, F.lit(" "), F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(low, T.CHECK_INBOX, " "), T.DM_CLAUSE, " ")
    tried = F.when(F.lower(said).rlike(T.TRIED), T.steps_mentioned(said)).otherwise(F.array().cast("array<string>"))
    drafted = T.steps_mentioned(low)
    checks = {
        "too_long": F.length(draft) > most,
        "unsupported_link": F.size(F.array_except(links(draft), links(evidence))) > 0,
        "placeholder": low.rlike(r"<\s*url\s*>"),
        "unsupported_amount": F.exists(amounts, lambda a: ~F.contains(F.replace(evidence, F.lit(" "), F.lit("")), a)),
        "dm_deflection": low.rlike(T.DM_ASK) & (F.size(T.steps_mentioned(rest)) == 0),
        "repeats_tried_steps": F.size(F.array_intersect(tried, drafted)) > 0,
        "unsupported_steps": (F.size(drafted) > 0) & (F.size(F.array_intersect(drafted, T.steps_mentioned(evidence))) == 0),
    }
    failed = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())))
    return F.when(draft == "", F.array(F.lit("empty"))).otherwise(failed)
