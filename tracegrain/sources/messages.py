"""What the messages of system programs mean: the programs' own formats of messages, compiled to one expression.

A format is written as the program prints it, with slots for what changes: {name} is a word, {name?} a word or nothing, {name~} any text, {name=kind} what KINDS
says; <...> may be missing, ... is any text, a $ at its end is the end of the message. A format that doesn't begin with ... begins the message.
Slots named like an event's fields fill them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shape import group, labelled, tags

FIELDS = ("actor", "src_ip", "dst_ip", "target", "command")
KINDS = {
    "number": r"\d+", "address": r"[0-9A-Fa-f.:]*[0-9A-Fa-f]", "print": r"SHA256:\S+", "quoted": r"[^']+", "item": r"[^,]+", "maybe_item": r"[^,]*", "before_colon": r"[^:]+", "service": r"[^:)]+", "su_service": r"su(?:-l)?", "in_brackets": r"[^)]*",
    "name": r"[^\s(]+", "settings": r"(?:[A-Z]+=.*? ; )*?", "blanks": r" *", "quote": r"[`']", "account": "authenticating|invalid", "action": "REPLACE|END EDIT|DELETE", "verdict": r"[^\]]*(?:UFW |DROP|REJECT|BLOCK)[^\]]*",
    "directory": r"\(?[^\s)]*\)? ?", "unknown": "invalid user ", "refused": "FAILED SU ", "down": "powering|rebooting|halting", "stop": r"\.?",
}


@dataclass(frozen=True)
class Said:
    """programs: whose message; form: its format; kind: the event; also: fields with a text of their own, or with another slot's value; tags: a word, word:{slot}, or `word if slot`."""

    programs: tuple[str, ...]
    form: str
    kind: str
    tags: tuple[str, ...] = ()
    also: dict[str, str] = field(default_factory=dict)

    def compiled(self) -> tuple[str, dict[str, int]]:
        """The expression, and the number of each slot's group."""
        out, slots = ("", {}) if self.form.startswith("...") else ("^", {})
        for text, name, mark, kind in re.findall(r"([^{}<>$.]+|\.\.\.|[<>$.])|\{(\w+)([?~]?)(?:=(\w+))?\}", self.form):
            if not text:
                inner = KINDS[kind] if kind else {"": r"\S+", "?": r"\S*", "~": r".*?"}[mark]
                if name != "_":
                    slots[name] = len(slots) + 1
                out += f"(?:{inner})" if name == "_" else f"({inner})"
            else:
                out += {"...": ".*", "<": "(?:", ">": ")?", "$": "$"}.get(text) or re.escape(text)
        return out.removeprefix(".*"), slots


SSH, CRON, KERNEL, ANY = ("sshd", "sshd-session"), ("CRON", "CROND", "cron", "crond", "crontab"), ("kernel",), ()
_PAM = "...pam_unix({service=service}{_=in_brackets}): "
# Formats of the programs' messages, by program; of two that fit a message the first counts.
TABLE = [
    # the kernel
    Said(KERNEL, "...Linux version {target}", "system.boot", ("kernel",)),
    Said(KERNEL, "...[{fw=verdict}]... SRC={src_ip} DST={dst_ip}<... PROTO={proto}><... DPT={dport=number}>", "kernel.message", ("kernel", "firewall", "fw:{fw}", "proto:{proto}", "dport:{dport}")),
    # cron and what runs like it
    Said(CRON, "({actor}) CMD ({command~})$", "cron.exec", ("cron",)),
    Said(CRON, "({actor}) {action=action} ({target})", "cron.modify", ("cron", "action:{action}")),
    Said(("anacron",), "Job {_=quote}{target=quoted}' started", "cron.exec", ("anacron",)),
    Said(("run-parts",), "{_=directory}starting {command}", "cron.exec", ("run-parts",)),
    # accounts and groups
    Said(("useradd",), "new user: name={target=item}, UID={uid=number}, GID={gid=number}<, home={home=maybe_item}><, shell={shell=maybe_item}>", "user.create", ("uid:{uid}", "gid:{gid}", "home:{home}", "shell:{shell}")),
    Said(("useradd", "groupadd"), "new group: name={target=item}", "group.modify", ("group_create", "group:{target}")),
    Said(("useradd", "groupadd"), "group added to {_=before_colon}: name={listed=item}", "group.modify", ("group_create", "group:{listed}")),
    Said(("useradd", "usermod"), "add '{target=quoted}' to <shadow >group '{group=quoted}'", "group.modify", ("group:{group}",)),
    Said(("gpasswd",), "user {target} added by {actor} to group {group}", "group.modify", ("group:{group}",)),
    Said(("userdel",), "delete user '{target=quoted}'", "user.delete"),
    Said(("usermod",), "change user '{target=quoted}' password", "password.change"),
    Said(("usermod", "chage"), "...user '{target=quoted}'", "user.modify"),
    # who becomes whom
    Said(("su",), "<{refused=refused}>(to {target}) {actor} on {tty}", "auth.su", ("su_failed if refused", "tty:{tty}")),
    Said(("sudo",), "{_=blanks}{actor} : <{reason~} ; >TTY={tty?} ; PWD={pwd~} ; USER={target} ; {_=settings}COMMAND={command~}$", "auth.sudo", ("tty:{tty}", "pwd:{pwd}", "sudo_failed if reason", "reason:{reason}")),
    # the SSH server, from a connection to its end
    Said(SSH, "Server listening on", "service.start", ("ssh",), {"target": "sshd"}),
    Said(SSH, "Connection from {src_ip} port {_=number} on {dst_ip}", "other", ("ssh", "connection")),
    Said(SSH, "Accepted key {key_type} {key} found at {target~}:{line=number}$", "other", ("ssh", "key:{key}", "key_type:{key_type}", "key_line:{line}")),
    Said(SSH, "Accepted {method} for {actor} from {src_ip} port {_=number}<...{key=print}>", "auth.login.success", ("ssh", "method:{method}", "key:{key}")),
    Said(SSH, "Failed {method} for <{unknown=unknown}>{actor?} from {src_ip}", "auth.login.failure", ("ssh", "method:{method}", "invalid_user if unknown")),
    Said(SSH, "...maximum authentication attempts exceeded for <{unknown=unknown}>{actor} from {src_ip}", "auth.login.failure", ("ssh", "max_attempts", "invalid_user if unknown")),
    Said(SSH, "Invalid user {actor?} from {src_ip}", "other", ("ssh", "invalid_user")),
    Said(SSH, "Disconnected from user {actor} {src_ip}", "auth.logout", ("ssh",)),
    Said(SSH, "Disconnected from <{_=account} user {actor} >{src_ip}", "other", ("ssh", "disconnect")),
    *(Said(SSH, f"{begin} <{{_=account}} user {{actor}} >{{src_ip=address}}", "other", ("ssh", "disconnect")) for begin in ("Connection closed by", "Connection reset by", "Received disconnect from")),
    # services and sessions
    Said(("rsyslogd",), "...] start$", "service.start", ("logging",), {"target": "rsyslogd"}),
    Said(("rsyslogd",), "...exiting on signal {signal=number}", "service.stop", ("logging", "signal:{signal}"), {"target": "rsyslogd"}),
    Said(("systemd",), "Started {target~}{_=stop}$", "service.start", ("systemd",)),
    Said(("systemd",), "Stopped {target~}{_=stop}$", "service.stop", ("systemd",)),
    Said(("systemd",), "Failed to start {target~}{_=stop}$", "other", ("systemd", "service_failed")),
    Said(("systemd-journald",), "Journal started", "service.start", ("logging",), {"target": "systemd-journald"}),
    Said(("systemd-journald",), "Journal stopped", "service.stop", ("logging",), {"target": "systemd-journald"}),
    Said(("systemd-logind",), "New session {session} of user {actor~}{_=stop}$", "auth.session.open", ("logind", "session:{session}")),
    Said(("systemd-logind",), "Removed session {session~}{_=stop}$", "auth.session.close", ("logind", "session:{session}")),
    Said(("systemd-logind",), "System is {_=down}", "system.shutdown", ("logind",)),
    # PAM, whatever the program
    Said(ANY, "...pam_unix({_=su_service}:{_=in_brackets}): session opened for user {target=name}<{_?} by {actor=name}>", "auth.su", ("pam", "service:su", "by:{actor}")),
    Said(ANY, _PAM + "session opened for user {actor=name}<{_?} by {by=name}>", "auth.session.open", ("pam", "service:{service}", "by:{by}"), {"target": "{actor}"}),
    Said(ANY, _PAM + "session closed for user {actor=name}", "auth.session.close", ("pam", "service:{service}"), {"target": "{actor}"}),
    Said(ANY, _PAM + "password changed for {target}", "password.change", ("pam", "service:{service}")),
    Said(ANY, _PAM + "authentication failure;<... rhost={src_ip?}><... user={actor?}>", "other", ("pam", "service:{service}", "pam_auth_failure")),
]
# What other messages of the kernel are about, by words in them.
KERNEL_WORDS = {
    "crash": ("segfault at", "general protection fault"), "oom": ("Out of memory", "oom-kill"), "taint": ("taints kernel", "module verification failed", "out-of-tree module"), "promiscuous": ("entered promiscuous mode",),
    "usb": ("usb ", ": new "), "audit": ("audit: ", "audit("), "io_error": ("fs error", "I/O error"),
}
AUTH_PROGRAMS = ("sshd", "sshd-session", "sudo", "su", "useradd", "groupadd", "usermod", "gpasswd", "chage", "userdel", "passwd", "systemd-logind", "login", "polkitd")
CRON_PROGRAMS = (*CRON, "anacron", "run-parts")


def plain_program(program: Column) -> Column:
    """The name up to a parenthesis."""
    return F.substring_index(program, "(", 1)


def _tag(said: str, groups: dict[str, Column]) -> Column:
    word, _, slot = said.partition(" if ")
    if slot:
        return F.when(groups[slot].isNotNull(), word)
    word, _, slot = said.partition(":{")
    return labelled(word, groups[slot[:-1]]) if slot else F.lit(word)


def _kernel_tag(message: Column) -> Column:
    """What another message of the kernel is about, null if nothing that is known."""
    out = None
    for tag, words in KERNEL_WORDS.items():
        held = [message.contains(w) for w in words]
        if tag == "usb":
            test = message.rlike(r"\busb \S+: new ")
        elif tag == "audit":
            test = message.startswith(words[0]) | message.rlike(r"\baudit\(\d")
        else:
            test = held[0]
            for h in held[1:]:
                test = test | h
        out = F.when(test, tag) if out is None else out.when(test, tag)
    return out


def classify(program: Column, message: Column) -> Column:
    """(event_type, the FIELDS, tags) of a message: the first format of TABLE that fits; other without anything if none does."""
    none = F.lit(None).cast("string")

    def struct(kind: str, fields: dict[str, Column], named: list[Column]) -> Column:
        return F.struct(F.lit(kind).alias("event_type"), *(fields.get(f, none).alias(f) for f in FIELDS), tags(*named).cast("array<string>").alias("tags"))

    out = None
    for said in TABLE:
        pattern, slots = said.compiled()
        groups = {name: group(message, pattern, i) for name, i in slots.items()}
        fields = {f: groups[f] for f in FIELDS if f in groups} | {f: groups[v[1:-1]] if v.startswith("{") else F.lit(v) for f, v in said.also.items()}
        test = (program.isin(*said.programs) if said.programs else message.contains("pam_unix(")) & message.rlike(pattern)
        value = struct(said.kind, fields, [_tag(t, groups) for t in said.tags])
        out = F.when(test, value) if out is None else out.when(test, value)
    out = out.when(program.isin(*KERNEL), struct("kernel.message", {}, [F.lit("kernel"), _kernel_tag(message)]))
    return out.otherwise(struct("other", {}, []))
