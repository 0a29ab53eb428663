"""Source types, their authority, and safe scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source types from the most to the least authoritative, their labels and bonuses.
PRIORITY = ("act", "rules", "notification", "circular", "faq", "user_guide", "help", "other")
LABELS = {"act": "Act", "rules": "Rules", "notification": "Notification", "circular": "Circular", "faq": "FAQ", "user_guide": "User Guide", "help": "Help", "other": "Other"}
BONUSES = {"act": 0.08, "rules": 0.08, "notification": 0.06, "circular": 0.05, "faq": 0.02, "user_guide": 0.01}
AUTHORITATIVE = ("act", "rules", "notification")


def _text(value: Column) -> Column:
    return F.lower(F.coalesce(value.cast("string"), F.lit("")))


def classify_source_type(title: Column, url: Column, domain: Column, source_id: Column, explicit: Column | None = None) -> Column:
    """The explicit type where it is a known one, else what title, URL, domain and source id tell, first rule first."""
    given = F.lower(F.btrim(_text(explicit if explicit is not None else F.lit(""))))
    title, url, domain, source_id = map(_text, (title, url, domain, source_id))
    text = F.concat_ws(" ", title, url, domain, source_id)
    return (
        F.when(given.isin(*PRIORITY), given)
        .when(title.startswith("faq") | source_id.contains("faq"), "faq")
        .when(title.contains("manual") | source_id.contains("manual"), "user_guide")
        .when(text.rlike(r"\bnotification\b"), "notification")
        .when(text.rlike(r"\bcircular\b"), "circular")
        .when(text.rlike(r"\brules\b") | title.startswith("rule"), "rules")
        .when(text.rlike(r"\bact\b"), "act")
        .when(domain.contains("userguide") | domain.contains("tutorial") | domain.contains("cbt"), "user_guide")
        .when(domain.contains("help"), "help")
        .otherwise("other")
    )


def _lookup(values: Mapping, key: Column, default: object) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default) if not isinstance(default, Column) else default)


def authority_rank(source_type: Column) -> Column:
    """0 for the most authoritative; unknown types are last."""
    return _lookup({t: i for i, t in enumerate(PRIORITY)}, source_type, len(PRIORITY) - 1)


def authority_bonus(source_type: Column, bonuses: Mapping[str, float] | None = None) -> Column:
    bonuses = BONUSES if bonuses is None else bonuses
    return _lookup(bonuses, source_type, 0.0) if bonuses else F.lit(0.0)


def source_type_label(source_type: Column) -> Column:
    return _lookup(LABELS, source_type, source_type)


def safe_score(score: Column) -> Column:
    """The score as a double; 0.0 where it is missing or no number."""
    return F.coalesce(score.try_cast("double"), F.lit(0.0))
