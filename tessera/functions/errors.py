"""A-28, A-29: error recognition and classification as column expressions.

The same rules exist as plain Python (``is_unavailable``) for use inside the
generation task, where the error is a live exception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: substrings that the reference matches (lower case) ------
UNAVAILABLE_TYPE = "notfound"
UNAVAILABLE_TEXT = ("404", "is no longer available", "is not found",
                    "not supported for generatecontent")
TIMEOUT_TEXT = ("read timed out", "timeout")
CERTIFICATE_TEXT = ("certificate_verify_failed", "self signed certificate")
BLOCKED_TEXT = ("10013", "permission denied")
PUBLIC_TIMEOUT_TEXT = ("tempo limite excedido", "read timed out", "timeout")
UNEXPECTED_TEXT = "Erro inesperado ao processar os arquivos: "
BROWSER_CERTIFICATE_TEXT = ("certificado", "certificate_verify_failed")
BROWSER_TIMEOUT_TEXT = ("tempo limite", "read timed out", "timeout")
# ---------------------------------------------------------------------------

#: What a caller is told, by public kind (the service is not named).
PUBLIC_TEXT = {
    "certificate": "A conexão com o serviço de IA falhou porque a rede intercepta o certificado HTTPS.",
    "timeout": "O serviço de IA demorou mais do que o limite configurado. Tente gerar novamente.",
    "blocked": "A conexão de saída com o serviço de IA foi bloqueada. Verifique firewall, VPN ou proxy.",
}


def is_unavailable(exc: BaseException) -> bool:
    """A-28 in Python: a model/candidate that does not exist (try the next)."""
    detail = str(exc).lower()
    return UNAVAILABLE_TYPE in type(exc).__name__.lower() or any(t in detail for t in UNAVAILABLE_TEXT)


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def unavailable(error_type: Column, message: Column) -> Column:
    """A-28 as a column."""
    return F.lower(error_type).contains(UNAVAILABLE_TYPE) | _any(F.lower(message), UNAVAILABLE_TEXT)


def client_kind(error_type: Column, message: Column) -> Column:
    """A-29, client side: timeout, certificate, blocked, other (first match;
    the detail is "Type: message")."""
    detail = F.lower(F.concat(error_type, F.lit(": "), message))
    return (F.when(_any(detail, TIMEOUT_TEXT), F.lit("timeout"))
            .when(_any(detail, CERTIFICATE_TEXT), F.lit("certificate"))
            .when(_any(detail, BLOCKED_TEXT), F.lit("blocked"))
            .otherwise(F.lit("other")))


def public_kind(error_type: Column, message: Column) -> Column:
    """A-29, public side: certificate is tested *before* timeout, on the
    client's wrapped message (whose wording carries the client kind)."""
    detail = F.lower(F.concat(error_type, F.lit(": "), message))
    ck = client_kind(error_type, message)
    return (F.when((ck == "certificate") | detail.contains("certificate_verify_failed")
                   | detail.contains("certificado ssl"), F.lit("certificate"))
            .when((ck == "timeout") | _any(detail, PUBLIC_TIMEOUT_TEXT), F.lit("timeout"))
            .when(_any(detail, BLOCKED_TEXT), F.lit("blocked"))
            .otherwise(F.lit("other")))


def status_code(error_type: Column, message: Column) -> Column:
    """A-29: 504 for a timeout, else 502."""
    detail = F.lower(F.concat(error_type, F.lit(": "), message))
    ck = client_kind(error_type, message)
    return F.when((ck == "timeout") | _any(detail, PUBLIC_TIMEOUT_TEXT), F.lit(504)).otherwise(F.lit(502))


def public_text(error_type: Column, message: Column, texts: dict[str, str] = PUBLIC_TEXT) -> Column:
    """A-29: the text for the caller by public kind; any other error's own message."""
    kind = public_kind(error_type, message)
    out = F.when(F.lit(False), F.lit(""))
    for name, text in texts.items():
        out = out.when(kind == name, F.lit(text))
    return out.otherwise(message)


def response(stage: Column, error_type: Column, message: Column) -> Column:
    """A-29, A-32: struct (status, detail) of a failed request by the stage that
    failed: a rejected ``upload`` is 400 with its own message, a failed
    ``generation`` 504 or 502 with the public text, anything else 500."""
    upload, generation = stage == "upload", stage == "generation"
    status = (F.when(upload, F.lit(400)).when(generation, status_code(error_type, message))
              .otherwise(F.lit(500)))
    detail = (F.when(upload, message).when(generation, public_text(error_type, message))
              .otherwise(F.concat(F.lit(UNEXPECTED_TEXT), message)))
    return F.struct(status.alias("status"), detail.alias("detail"))


def browser_kind(message: Column) -> Column:
    """A-29, the browser's copy of the rules, on the text it receives."""
    m = F.lower(message)
    return (F.when(_any(m, BROWSER_CERTIFICATE_TEXT), F.lit("certificate"))
            .when(_any(m, BROWSER_TIMEOUT_TEXT), F.lit("timeout"))
            .when(_any(m, BLOCKED_TEXT), F.lit("blocked"))
            .otherwise(F.lit("other")))
