"""Is a string a secret? By the name it is assigned to, by what it is not, and by how random it looks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that make a name a secret's, and words after which it is something else about one.
SECRET_WORDS = "password|passwd|passphrase|pwd|pass|secret|token|key|apikey|credential|credentials|auth"
ABOUT_WORDS = "file|path|name|id|length|len|max|min|count|limit|size|url|uri|type|policy|field|label|hint|env|expiry|ttl|prefix|suffix|format|dir|version|algorithm|public"
PLACEHOLDER = r"(?i)^(?:<[^>]*>|\$\{[^}]*\}|\{\{.*\}\}|\$\([^)]*\)|%[A-Za-z_]+%|\$[A-Za-z_]\w*|x{3,}|\*{3,}|\.{3,}|your[-_ ]?.*|change[-_ ]?me.*|example.*|placeholder.*|dummy.*|sample.*|todo.*|none|null|true|false|undefined|redacted|password|secret|token|string|os\.environ.*|os\.getenv.*|process\.env.*|env\(.*|getenv\(.*|config\..*|self\..*|settings\..*)$"


def name_words(key: Column) -> Column:
    """The words of a name, in lower case: split at marks and where a capital follows a small letter."""
    return F.filter(F.split(F.lower(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+"), lambda w: w != "")


def named_secret(key: Column) -> Column:
    """db_password, API_KEY and clientSecret name a secret; password_file and max_tokens do not."""
    words = name_words(key)
    last = F.element_at(words, -1)
    return (F.size(words) > 0) & F.coalesce(last.rlike(f"^(?:{SECRET_WORDS})$"), F.lit(False)) & ~F.exists(words, lambda w: w.rlike(f"^(?:{ABOUT_WORDS})$"))


def entropy(value: Column) -> Column:
    """Shannon bits a character."""
    letters = F.split(value, "")
    n = F.greatest(F.char_length(value), F.lit(1))
    share = lambda c: (F.char_length(value) - F.char_length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.filter(letters, lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def mixed(value: Column) -> Column:
    """Letters and digits both, as random strings have."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]")


def secret_delta(value: Column) -> Column:
    """What a value adds to the score of a secret: placeholders and look-ups are none, plain words hardly."""
    kinds = value.rlike("[a-z]").cast("int") + value.rlike("[A-Z]").cast("int") + value.rlike("[0-9]").cast("int") + value.rlike("[^A-Za-z0-9]").cast("int")
    return F.when(value.rlike(PLACEHOLDER), -0.5).when(value.rlike(r"^(?:https?|file)://"), -0.4).when((kinds == 1) & ~value.rlike("[0-9]"), -0.2).when(kinds >= 3, 0.1).otherwise(0.0)


def entropy_delta(value: Column) -> Column:
    bits = entropy(value)
    return F.when(value.rlike(PLACEHOLDER), -0.5).when(bits >= 4.0, 0.15).when(bits >= 3.3, 0.05).otherwise(-0.2)
