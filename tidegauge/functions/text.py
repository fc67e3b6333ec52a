"""Log text: normalised bodies, template keys, masked tokens."""

from pyspark.sql import functions as F

# What counts as a uuid, a hex word and a number in a log body, and
# as a variable token of a template. Order of use matters: uuid, hex, number.
UUID = (
    r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-"
    r"[89ab][0-9a-f]{3}-[0-9a-f]{12}(?![0-9a-f])"
)
HEX = (
    r"(?i)(?<![0-9a-z])(?:0x[0-9a-f]+|(?=[0-9a-f]{8,}(?![0-9a-z]))"
    r"(?=[0-9a-f]*[a-f])[0-9a-f]{8,})(?![0-9a-z])"
)
NUMBER = r"(?iU)(?<!\w)[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[-+]?\d+)?(?!\w)"
VARIABLE_TOKEN = (
    r"(?i)^(?:[-+]?\d+(?:\.\d+)?|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|"
    r"[0-9a-f]{16,}|(?:\d{1,3}\.){3}\d{1,3})$"
)
SPACE = r"(?U)\s+"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def squeeze(text):
    """Collapse runs of whitespace and trim."""
    return F.regexp_replace(F.regexp_replace(text, EDGE_SPACE, ""), SPACE, " ")


def normalize_body(text):
    out = squeeze(F.lower(text))
    out = F.regexp_replace(out, UUID, "<uuid>")
    out = F.regexp_replace(out, HEX, "<hex>")
    return F.regexp_replace(out, NUMBER, "<num>")


def template_key(event_name, body):
    """``event:<name>`` where the record names its event, else ``body:<normalised>``."""
    named = F.length(F.trim(event_name)) > 0
    return F.when(named, F.concat(F.lit("event:"), F.trim(event_name))).otherwise(
        F.concat(F.lit("body:"), normalize_body(body))
    )


def mask_tokens(text):
    """Replace variable tokens (numbers, ids, addresses) by ``<*>``."""
    tokens = F.split(squeeze(text), " ")
    masked = F.transform(
        tokens, lambda w: F.when(w.rlike(VARIABLE_TOKEN), F.lit("<*>")).otherwise(w)
    )
    return F.array_join(masked, " ")
