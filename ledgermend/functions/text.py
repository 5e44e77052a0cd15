"""Names, identifiers, account numbers, keys and redaction as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermend.functions.lets import bound
from ledgermend.functions.predicates import missing_exact, missing_trimmed


def plain(raw: Column) -> Column:
    """Lower case, other than letters and digits as single spaces; null if nothing is left."""
    text = F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "))
    return F.when(~missing_trimmed(raw), F.nullif(text, F.lit("")))


def table(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def enum_value(raw: Column, domain: Mapping[str, str]) -> Column:
    """The domain's value for the text without other signs, as it is, or single-spaced; else the text single-spaced."""
    text = F.lower(F.trim(raw))
    spaced = F.regexp_replace(text, r"\s+", " ")
    known = table(domain)
    keys = (F.regexp_replace(text, "[^a-z0-9]", ""), text, spaced)
    return F.when(~missing_trimmed(raw) & (text != ""), F.coalesce(*[F.try_element_at(known, k) for k in keys], spaced))


#: Payment frequencies that are named outright.
FREQUENCIES = {
    "monthly": "monthly", "per month": "monthly", "every month": "monthly", "once a month": "monthly", "monthly every month": "monthly", "month": "monthly",
    "bi weekly": "biweekly", "biweekly": "biweekly", "every other week": "biweekly", "fortnightly": "biweekly", "once every two weeks": "biweekly",
    "twice a month": "semimonthly", "twice monthly": "semimonthly", "two per month": "semimonthly", "semi monthly": "semimonthly", "semimonthly": "semimonthly", "semi monthly pay": "semimonthly",
    "weekly": "weekly", "per week": "weekly", "every week": "weekly", "once a week": "weekly",
    "quarterly": "quarterly", "per quarter": "quarterly", "every quarter": "quarterly",
    "annually": "annually", "annual": "annually", "per year": "annually", "every year": "annually", "once a year": "annually", "yearly": "annually",
}


def payment_frequency(raw: Column) -> Column:
    """A named frequency, else by the words it contains, else the plain text."""
    text = plain(raw)
    has = text.contains
    ladder = F.when(has("month"), F.when(has("twice") | has("two"), "semimonthly").otherwise("monthly"))
    ladder = ladder.when(has("week"), F.when(has("other") | has("two"), "biweekly").otherwise("weekly"))
    ladder = ladder.when(has("quarter"), "quarterly").when(has("year") | has("annual"), "annually").otherwise(text)
    return F.coalesce(F.try_element_at(table(FREQUENCIES), text), ladder)


def account_type(raw: Column, aliases: Mapping[str, str]) -> Column:
    """Lower case; dots, underscores, dashes and spaces alike; any kind of credit card is one."""
    text = F.regexp_replace(F.lower(F.trim(raw)), "[–—]", "-")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[._\s]+", " "), "^[- ]+|[- ]+$", ""))
    key = F.trim(F.regexp_replace(text, r"[-\s]+", " "))
    card = F.replace(key, F.lit("creditcard"), F.lit("credit card"))
    named = F.try_element_at(table(aliases), key) if aliases else F.lit(None).cast("string")
    return F.when(~missing_exact(raw) & (text != ""), F.coalesce(named, F.when(card.contains("credit card"), "credit card").otherwise(card)))


#: Legal forms in names, and account numbers that say there is none.
LEGAL_FORMS = r"\b(bank|usa|na|n.a\.|llc|inc|corp|co|company)\b"
NO_NUMBER = ("NA", "NONE", "NOTAVAILABLE", "NOTPROVIDED", "UNKNOWN")


def creditor(raw: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """The first alias, in order, that the name contains; else the name without legal forms and signs."""
    name = F.lower(F.trim(raw))
    bare = F.regexp_replace(name, LEGAL_FORMS, "")
    out = F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]", ""), r"\s+", " "))
    for alias, canonical in reversed(aliases):
        out = F.when(name.contains(alias), canonical).otherwise(out)
    return out


def issuer(raw: Column) -> Column:
    """Upper case; dots, dashes and slashes as spaces; runs of single letters joined."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[./\-]", " "), r"\s+", " "))
    return F.upper(F.regexp_replace(spaced, r"(?<=(?:^|\s)\S) (?=\S(?:\s|$))", ""))


def logical_key(issuer_name: Column, last4: Column, kind: Column, opened: Column) -> Column:
    """A stable key of what identifies an account; null without any anchor."""
    name = issuer(issuer_name)
    four, day, sort = (F.trim(F.coalesce(c, F.lit(""))) for c in (last4, opened, kind))
    tail = F.concat(F.lit("|I:"), name, F.lit("|T:"), F.upper(sort), F.lit("|D:"), day)
    basis = F.when(four != "", F.concat(F.lit("L4:"), four, tail)).otherwise(F.concat(F.lit("NO4"), tail))
    return F.when((name != "") | (four != "") | (day != ""), F.substring(F.sha1(basis.cast("binary")), 1, 16))


def digits(raw: Column) -> Column:
    return F.when(~missing_exact(raw), F.nullif(F.regexp_replace(raw, r"\D", ""), F.lit("")))


def masked(account: Column) -> Column:
    """Four stars and the last four digits."""
    return F.concat(F.lit("****"), F.right(F.regexp_replace(account, r"\D", ""), F.lit(4)))


def number_mask(raw: Column) -> Column:
    """The canonical form: separators gone, each run of mask signs one star, upper case."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\s\-.]+", "")
    return F.upper(F.regexp_replace(text, "[*xX•●]+", "*"))


def visible_match(a: Column, b: Column) -> Column:
    """Whether the shorter string of visible digits lies in the longer; false without digits on both sides."""
    x, y = (F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "") for c in (a, b))
    inside = F.when(F.length(x) <= F.length(y), F.instr(y, x) > 0).otherwise(F.instr(x, y) > 0)
    return (x != "") & (y != "") & inside


def strict_level(a: Column, b: Column) -> Column:
    """``match`` when letters and digits agree, else the reason why not."""
    x, y = (F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")) for c in (a, b))
    dx, dy = (F.regexp_replace(c, r"\D", "") for c in (x, y))
    numeric = x.rlike(r"^\d+$") & y.rlike(r"^\d+$")
    reason = F.when((x != "") & (x == y), "match").when((dx == "") & (dy == ""), "empty")
    reason = reason.when((x != "") & (y != "") & ~numeric, "alnum_conflict").when((dx != "") & (dy != "") & (dx != dy), "digit_conflict")
    return reason.when((x != "") & (y != ""), "alnum_conflict").otherwise("insufficient_data")


def number_class(raw: Column) -> Column:
    """How an account number is shown: missing, masked, last four only, and so on."""
    text = F.upper(F.trim(raw))
    n = F.length(F.regexp_replace(text, r"\D", ""))
    letters = F.regexp_replace(text, "[^A-Z]+", "")
    none = F.when((letters == "") | letters.isin(*NO_NUMBER) | text.rlike(r"^[\s\-#*X]+$"), "missing").otherwise("nondigit")
    some = F.when(text.rlike("[#*X]"), F.when(n <= 4, "masked_last4").otherwise("masked"))
    some = some.when(text.rlike("[A-Z]"), F.when(n <= 4, "text_last4").otherwise("alphanumeric")).when(n <= 4, "last4_only").otherwise("unmasked")
    return F.when(missing_trimmed(raw), "missing").when(n == 0, none).otherwise(some)


def number_display(raw: Column) -> Column:
    """Display, last four and class; null when missing."""
    kind, shown = number_class(raw), F.trim(raw)
    last = F.right(F.regexp_replace(shown, r"\D", ""), F.lit(4))
    return F.when(kind != "missing", F.struct(shown.alias("display"), F.when(F.length(last) == 4, last).alias("last4"), kind.alias("mask_class")))


#: What is redacted, in this order.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
SSN = r"\b(?:\d{3}[- ]\d{2}[- ]|\d{5})(\d{4})\b"
SSN_TAIL = r"(?i)(ssn[\s:#-]*)(\d{4})"
ACCOUNT = r"\b(?:\d{4}[ -]?){2,4}(\d{4})\b"


def redacted(text: Column) -> Column:
    """Mail addresses and phone numbers gone; social security and account numbers down to four digits."""
    out = F.coalesce(text, F.lit(""))
    for pattern, new in ((EMAIL, "[REDACTED]"), (PHONE, "[REDACTED]"), (SSN, "***-**-$1"), (SSN_TAIL, "$1***-**-$2"), (ACCOUNT, "****$1")):
        # What every match contains is looked for first: most texts have none of it.
        out = F.when(_may_hold(out, pattern), F.regexp_replace(out, pattern, new)).otherwise(out)
    return out


def _may_hold(text: Column, pattern: str) -> Column:
    return text.contains("@") if pattern == EMAIL else text.rlike(r"\d{4}")


def redaction_counts(text: Column) -> Column:
    """How many of each kind stand in the unredacted text."""
    count = lambda p: F.coalesce(F.when(_may_hold(text, p), F.regexp_count(text, F.lit(p))), F.lit(0)).cast("long")
    return F.struct(count(EMAIL).alias("emails"), count(PHONE).alias("phones"), count(SSN).alias("ssns"), count(ACCOUNT).alias("accounts"))


#: Words and patterns by which the kind of a report value is told.
ACCOUNT_STATUSES = ("open", "closed", "paid", "current", "delinquent", "chargeoff", "collection")
PAYMENT_STATUSES = ("current", "late", "ok", "paid", "120", "90", "60", "30", "co", "cof", "collection/chargeoff")
ACCOUNT_RATINGS = ("individual", "joint", "authorized user", "co-signer", "authorized", "authorizeduser")
CREDITOR_TYPES = ("bank - mortgage loans", "mortgage companies - finance", "bank", "credit card", "auto loan")
ENUM_WORDS = ("closed", "current", "paid", "individual", "open", "delinquent")
TEXT_WORDS = ("mortgage", "loan", "card", "finance", "bank", "company")
HISTORY_STATUSES = ("ok", "30", "60", "90", "120", "150", "180")
HEBREW_MONTHS = ("ינו׳", "פבר׳", "מרץ", "אפר׳", "מאי", "יוני", "יולי", "אוג׳", "ספט׳", "אוק׳", "נוב׳", "דצמ׳")
ENGLISH_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _has_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def value_type(text: Column) -> Column:
    """What a report value looks like: empty, money, date, term, enum, text or id, by the first test that it passes."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    listed = low.isin(*ACCOUNT_STATUSES, *PAYMENT_STATUSES, *ACCOUNT_RATINGS, *CREDITOR_TYPES)
    return (
        F.when(t == "", "empty").when(t.rlike(r"\$\s*\d"), "money").when(t.rlike(r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b"), "date")
        .when(t.rlike(r"(?i)\b\d{2,4}\s*month\(s\)\b"), "term").when(listed | _has_any(low, ("chargeoff", "collection", *ENUM_WORDS)), "enum")
        .when(_has_any(low, TEXT_WORDS), "text").when(low.rlike(r"\b[\d*]{4,}\b"), "id").otherwise("text")
    )


def history_token(text: Column) -> Column:
    """Whether a text is a payment status or starts with a month."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    return low.isin(*HISTORY_STATUSES) | t.isin(*HEBREW_MONTHS) | F.left(low, F.lit(3)).isin(*ENGLISH_MONTHS)


def bare_label(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", "")


def canonical_labels(lines: Column, plain_labels: Sequence[str]) -> Column:
    """Labels of an account block: lines above the first bureau name that end in a colon or are known without one, each once."""
    trimmed = F.transform(lines, lambda t: F.trim(F.coalesce(t, F.lit(""))))
    end = lambda t: F.array_position(F.transform(t, lambda x: bare_label(x).isin("transunion", "experian", "equifax")), True)
    above = bound(trimmed, lambda t: F.when(end(t) > 0, F.slice(t, F.lit(1), (end(t) - 1).cast("int"))).otherwise(t))
    kept = F.filter(above, lambda t: (t != "") & (t.endswith(":") | bare_label(t).isin(*plain_labels)))
    first = lambda k: F.filter(k, lambda t, n: F.array_position(F.transform(k, bare_label), bare_label(t)) == n + 1)
    return bound(kept, first)


def history_text(raw: Column) -> Column:
    """Lower case, white space single; null for missing values."""
    text = F.lower(F.regexp_replace(F.trim(raw), r"\s+", " "))
    return F.when(~missing_exact(raw), F.nullif(text, F.lit("")))


def keyword_hit(normalized: Column, raw: Column, rules: Sequence[Mapping[str, str]]) -> Column:
    """The first rule that a value meets: struct of rule_hit and matched, or null.

    A rule has an ``id`` and either a ``pattern`` (on the normalized value, or with ``match_on`` raw on the
    raw one; case doesn't matter) or a ``value`` that the normalized value contains.
    """
    hits = []
    for rule in rules:
        if "pattern" in rule:
            target = F.coalesce(raw if rule.get("match_on") == "raw" else normalized, F.lit(""))
            pattern = "(?i)" + rule["pattern"]
            hits.append(F.when(target.rlike(pattern), F.struct(F.lit(rule["id"]).alias("rule_hit"), F.regexp_extract(target, pattern, 0).alias("matched"))))
        else:
            hits.append(F.when(normalized.contains(rule["value"].strip().lower()), F.struct(F.lit(rule["id"]).alias("rule_hit"), F.lit(rule["value"]).alias("matched"))))
    return F.coalesce(*hits)


def checked_letter(letter: Column, private: Sequence[tuple[str, str]], rules: Sequence[tuple[str, str, str | None]]) -> Column:
    """A letter with personal data and forbidden phrases replaced, and how often each rule was broken: struct of text and violations.

    ``private`` are (rule, pattern) on the letter as it is; then ``rules`` of rule, pattern (case doesn't matter) and
    replacement, if it has one, one after the other.
    """
    count = lambda text, pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    entry = lambda rule, n: F.struct(F.lit(rule).alias("rule"), n.alias("n"))
    found = [entry(rule, count(letter, pattern)) for rule, pattern in private]
    text = redacted(letter)
    for rule, pattern, new in rules:
        found.append(entry(rule, count(text, "(?i)" + pattern)))
        text = F.regexp_replace(text, "(?i)" + pattern, new) if new is not None else text
    return F.struct(text.alias("text"), F.filter(F.array(*found), lambda e: e["n"] > 0).alias("violations"))


def ai_payload(fields: Column, allowed: Sequence[str], account: str = "account_number") -> Column:
    """What may leave for a model from a map of fields: the allowed ones, redacted; which allowed ones there are; the account's last four digits."""
    names = F.array(*[F.lit(n) for n in allowed])
    kept = F.transform_values(F.map_filter(fields, lambda k, v: F.array_contains(names, k)), lambda k, v: F.when(v.isNotNull(), redacted(v)))
    own = F.regexp_replace(F.try_element_at(fields, F.lit(account)), r"\D", "")
    there = F.map_from_arrays(names, F.transform(names, lambda n: F.map_contains_key(fields, n)))
    return F.struct(kept.alias("fields"), there.alias("present"), F.when(F.length(own) >= 4, F.right(own, F.lit(4))).alias("last4"))


def summary_hash(*columns: str) -> Column:
    """SHA-256 of the JSON object of the columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256)
