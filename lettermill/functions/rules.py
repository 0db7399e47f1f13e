"""Rule lists: address to provider and server, probe results and errors to messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import domain_of, if_empty, if_zero

PORT = 993
#: Key, name, server (with {domain} for the address's domain).
PROVIDERS = [
    ("outlook", "Microsoft Outlook/Exchange", "outlook.office365.com"),
    ("exchangeOnline", "Microsoft Exchange Online", "outlook.office365.com"),
    ("exchangeOnPremise", "Microsoft Exchange On-Premise", "mail.{domain}"),
    ("gmail", "Gmail", "imap.gmail.com"),
    ("oneCom", "One.com", "imap.one.com"),
    ("generic", "Generic IMAP", "imap.{domain}"),
]
#: What a domain must contain for a provider, first match first.
DOMAINS = [("outlook", ["outlook.com", "hotmail.com", "live.com", "msn.com"]), ("gmail", ["gmail.com"]), ("oneCom", ["one.com"])]
#: Messages for errors by what their text contains, first match first.
ERRORS = [
    ("timeout", "Anslutningen tog för lång tid. Kontrollera värdnamn och port."),
    ("ENOTFOUND", "Servern hittades inte. Kontrollera värdnamnet."),
    ("ECONNREFUSED", "Anslutningen nekades. Kontrollera port och brandväggsinställningar."),
    ("authentication", "Autentiseringsfel. Kontrollera e-post och lösenord."),
    ("certificate", 'SSL-certifikatfel. Försök med "Exchange On-Premise" för företagsmejl.'),
]
UNKNOWN_ERROR = "Okänt fel vid anslutning"
#: The model that analyses messages, and marks for the states of its service.
MODEL = "gpt-oss:20b"
MARKS = [("available", "✅"), ("bridge_down", "🔴"), ("timeout", "⏱️"), ("model_unavailable", "❌"), ("error", "⚠️")]
#: What is said of a probe, with the server's answer or its name and port after or in it.
PROBE = {"tcp": "TCP-anslutning misslyckades: ", "tls": "TLS-anslutning misslyckades: ", "greeting": "IMAP-server svarar inte korrekt: ", "before": "Anslutning till ", "after": " fungerar!"}
#: Servers of known domains, by what a domain contains, and names to try at both ports.
KNOWN_SERVERS = [(("gmail", "googlemail"), "imap.gmail.com:993 (Gmail)"), (("outlook", "hotmail", "live"), "outlook.office365.com:993 (Outlook)"), (("one.com",), "imap.one.com:993 (One.com)")]
TRIED, TRIED_ALWAYS, TRIED_PORTS = ("imap.", "mail.", ""), ("imap.gmail.com", "outlook.office365.com"), (":993", ":143")
#: What is said of the model's service in each state, and of an analysis that failed.
STATES = {
    "bridge_down": "OpenAI Bridge (port 8085) is not responding - check if ollama-bridge.py is running",
    "timeout": "GPT-OSS service timeout (>5s) - service may be overloaded or starting up",
    "error": "GPT-OSS unavailable: ",
    "model_unavailable": "GPT-OSS 20B model not available in Ollama",
    "available": "GPT-OSS 20B ready for email analysis",
}
STATUS = " AI Service Status: "
FAILED = {
    "timeout": "⏱️ GPT-OSS analysis timeout (>30s) - service may be overloaded\n💡 Suggestion: Try with a shorter email or retry later",
    "busy": "🔄 GPT-OSS service temporarily unavailable (HTTP 503)\n💡 Suggestion: Model may be loading, try again in a few minutes",
    "before": "❌ Analysis failed: ",
    "after": "\n💡 Suggestion: Check AI service status with 'check_ai_status'",
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_match(cases: Sequence[tuple[Column, Column | str]], otherwise: Column | str) -> Column:
    """The value of the first condition that holds: an ordered CASE."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F
    for test, value in cases:
        out = out.when(test, as_column(value))
    return out.otherwise(as_column(otherwise))


def detect_provider(address: Column | str) -> Column:
    """By substrings of the lower-cased domain, so that phone.com counts as one.com does."""
    domain = F.lower(domain_of(address))
    cases = []
    for key, parts in DOMAINS:
        test = F.contains(domain, F.lit(parts[0]))
        for part in parts[1:]:
            test = test | F.contains(domain, F.lit(part))
        cases.append((test, key))
    return first_match(cases, "generic")


def provider_host(key: Column | str, address: Column | str) -> Column:
    """The server of a provider; that of `generic` for an unknown key. Without a domain, a server
    that has one in its name gets `undefined`."""
    domain = F.coalesce(domain_of(address), F.lit("undefined"))
    host = lambda name: F.concat(F.lit(name.removesuffix("{domain}")), domain) if "{" in name else F.lit(name)
    return first_match([(_col(key) == k, host(name)) for k, _, name in PROVIDERS[:-1]], host(PROVIDERS[-1][2]))


def server(address: Column | str, provider: Column | str, custom_host: Column | str, custom_port: Column | str) -> Column:
    """struct(host, port). A custom host wins; a custom port counts only with one."""
    custom = if_empty(custom_host, F.lit(None).cast("string"))
    key = F.coalesce(F.nullif(_col(provider), F.lit("")), detect_provider(address))
    port = F.when(custom.isNotNull(), if_zero(custom_port, PORT)).otherwise(F.lit(PORT))
    return F.struct(F.coalesce(custom, provider_host(key, address)).alias("host"), port.cast("int").alias("port"))


def suggest_hosts(address: Column | str, most: int = 5) -> Column:
    """Servers to try: the provider's own, then usual names at both ports; repeats stay."""
    raw = domain_of(address)
    domain = F.coalesce(raw, F.lit("undefined"))
    holds = lambda *parts: F.coalesce(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(raw, p)), F.lit(False))
    none = F.array().cast("array<string>")
    own = [(holds(*parts), server) for parts, server in KNOWN_SERVERS]
    names = F.array(*(F.concat(F.lit(name), domain) for name in TRIED), *map(F.lit, TRIED_ALWAYS))
    other = F.filter(names, lambda n: raw.isNull() | (n != raw))
    ports = F.flatten(F.transform(other, lambda n: F.array(*(F.concat(n, F.lit(port)) for port in TRIED_PORTS))))
    return F.slice(F.concat(*(F.when(test, F.array(F.lit(value))).otherwise(none) for test, value in own), ports), 1, most)


def connection_verdict(host: Column | str, port: Column | str, tls: Column | str, tcp_error: Column | str, tls_error: Column | str, greeting: Column | str) -> Column:
    """struct(success, message, tcp, tls) of a probe in three steps, of which the first that fails
    decides. An error is null where its step went well; the greeting must contain OK."""
    tcp_error, tls_error, greeting, tls = _col(tcp_error), _col(tls_error), F.trim(F.coalesce(_col(greeting), F.lit(""))), _col(tls)
    refused = tls & tls_error.isNotNull()
    mute = ~F.contains(greeting, F.lit("OK"))
    message = first_match(
        [
            (tcp_error.isNotNull(), F.concat(F.lit(PROBE["tcp"]), tcp_error)),
            (refused, F.concat(F.lit(PROBE["tls"]), tls_error)),
            (mute, F.concat(F.lit(PROBE["greeting"]), greeting)),
        ],
        F.concat(F.lit(PROBE["before"]), _col(host), F.lit(":"), _col(port).cast("string"), F.lit(PROBE["after"])),
    )
    good = tcp_error.isNull() & ~refused & ~mute
    return F.struct(good.alias("success"), message.alias("message"), tcp_error.isNull().alias("tcp"), (tcp_error.isNull() & tls & tls_error.isNull()).alias("tls"))


def error_message(text: Column | str) -> Column:
    """With regard to case; other errors speak for themselves."""
    text = _col(text)
    return first_match([(text.isNull(), UNKNOWN_ERROR), *((F.contains(text, F.lit(part)), said) for part, said in ERRORS)], text)


def service_status(error_code: Column | str, error_text: Column | str, models: Column | str) -> Column:
    """struct(status, message, shown) of the model service, from the error of asking it (null if
    none) and the models that it listed (null if none)."""
    code, models = _col(error_code), _col(models)
    has = F.coalesce(F.array_contains(models, F.lit(MODEL)), F.lit(False))
    failed = code.isNotNull() | _col(error_text).isNotNull()
    status = first_match([(failed & (code == "ECONNREFUSED"), "bridge_down"), (failed & (code == "ETIMEDOUT"), "timeout"), (failed, "error"), (~has, "model_unavailable")], "available")
    said = {name: F.lit(text) for name, text in STATES.items()} | {"error": F.concat(F.lit(STATES["error"]), F.coalesce(_col(error_text), F.lit("undefined")))}
    message = first_match([(status == name, text) for name, text in said.items()], "")
    mark = first_match([(status == name, sign) for name, sign in MARKS], "")
    shown = F.concat(mark, F.lit(STATUS), F.upper(status), F.lit("\n"), message)
    return F.struct(status.alias("status"), message.alias("message"), shown.alias("shown"))


def failure_message(error_code: Column | str, http_status: Column | str, error_text: Column | str) -> Column:
    """What an analysis that failed says."""
    said = F.concat(F.lit(FAILED["before"]), F.coalesce(_col(error_text), F.lit("undefined")), F.lit(FAILED["after"]))
    return first_match([(_col(error_code) == "ETIMEDOUT", FAILED["timeout"]), (_col(http_status) == 503, FAILED["busy"])], said)
