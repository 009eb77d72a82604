"""Checks of settings as column expressions. Nothing is sent or opened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.sources.requests import valid_email


def first_failure(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule whose condition doesn't hold (null counts as that); null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(said)) for holds, said in rules))


def _stripped(c) -> Column:
    return F.regexp_replace(c, r"\A(?U:\s+)|(?U:\s+)\z", "")


def mail_error(host, port, sender, recipient) -> Column:
    """What is wrong first with the settings of a mail server and a recipient; null if nothing is."""
    host, port, sender, recipient = map(F.col, (host, port, sender, recipient))
    port, to = _stripped(port), _stripped(recipient)
    whole = port.rlike(r"\A[+-]?[0-9]+\z")
    return first_failure(
        (whole, "The port must be a whole number between 1 and 65535."),
        (F.when(whole, port).try_cast("int").between(1, 65535), "The port must be between 1 and 65535."),
        ((host != "") & ~host.rlike(r"(?U)\s|://"), "The server must be a host name, not an address with a scheme."),
        (valid_email(sender), "The sender must be a valid email address."),
        (to != "", "A recipient is needed."),
        (valid_email(to), "The recipient must be a valid email address."),
    )


# The forms of a token, of an extension's origin and of a tunnel's target, and the hosts of this machine.
TOKEN, ORIGIN, TARGET = r"[!-~]{32,}", r"chrome-extension://[a-p]{32}", r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+"
LOOPBACK = ("127.0.0.1", "localhost")


def _is(c, form: str) -> Column:
    return F.coalesce(F.col(c).rlike(rf"\A(?:{form})\z"), F.lit(False))


def valid_token(c) -> Column:
    return _is(c, TOKEN)


def valid_origin(c) -> Column:
    return _is(c, ORIGIN)


def valid_target(c) -> Column:
    """A tunnel's target; none is fine."""
    c = F.coalesce(_stripped(c), F.lit(""))
    return (c == "") | c.rlike(rf"\A(?:{TARGET})\z")


def loopback_endpoint(c) -> Column:
    """An http address of this machine with a port."""
    parts = r"\A(?i:http)://(?:[^/?#]*@)?([^/?#@:]*):([0-9]+)(?:[/?#].*)?\z"
    host, port = (F.regexp_extract(c, f"(?s){parts}", n) for n in (1, 2))
    return F.coalesce(F.lower(host).isin(*LOOPBACK) & F.nullif(port, F.lit("")).try_cast("int").between(1, 65535), F.lit(False))


def checked(*checks: Column) -> Column:
    """A status over checks of one row: ``ok`` if all hold, else ``error``."""
    return F.when(reduce(lambda a, b: a & b, checks), "ok").otherwise("error")
