"""Text patterns, written once in ECMAScript form and adapted to each engine."""

from __future__ import annotations

REDACTED = "[REDACTED]"

# Object keys whose values are never shown
SENSITIVE_KEY = (
    r"(pass(word|wd|phrase)?|secret|token|api[-_]?key|apikey|authorization|auth[-_]?header|cookie|credential"
    r"|private[-_]?key|bearer|signature|client[-_]?secret|connection[-_]?string|dsn)"
)

# Credential shapes, and whether case is ignored; token shapes of a single product are left out
SECRETS = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", False),
    (r"\b(?:Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{8,}", False),
    (r"\bAKIA[0-9A-Z]{16}\b", False),
    (r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", False),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b", False),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", False),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", False),
    (r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp):\/\/[^\s:@/]+:[^\s@/]+@\S+", True),
]

# Literal parts a text must contain before a credential pattern can match: every group needs one hit.
SECRET_HINTS = [
    [["PRIVATE KEY-----"]],
    [["Bearer", "Basic"]],
    [["AKIA"]],
    [["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]],
    [["xox"]],
    [["sk-"]],
    [["eyJ"]],
    [["://"], ["@"]],
]

# Characters removed from text, as code point ranges
CONTROL = ((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x7F))
BIDI = ((0x200B, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069), (0xFEFF, 0xFEFF))
HIDDEN = ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFEFF, 0xFEFF))
# what ECMAScript's white space covers beyond ASCII
SPACE = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))


def char_class(ranges, braced: bool = False) -> str:
    """Body of a character class; ``braced`` for RE2, which writes code points in braces."""
    def one(c: int) -> str:
        return f"\\x{{{c:04x}}}" if braced else f"\\u{c:04x}"

    return "".join(one(lo) if lo == hi else f"{one(lo)}-{one(hi)}" for lo, hi in ranges)


# Instruction-shaped text, (id, severity, pattern); all ignore case, "fake-role-markup" is also multi-line
INJECTION = [
    (
        "override-instructions",
        "high",
        r"\b(ignore|disregard|forget|override|bypass)\b[^.\n]{0,40}\b(previous|prior|above|earlier|preceding|all|any|system|safety|security)\b[^.\n]{0,30}\b(instructions?|prompts?|rules?|guidelines?|messages?|constraints?|guardrails?|polic(?:y|ies))\b",
    ),
    (
        "role-hijack",
        "high",
        r"\b(you are now|from now on,? you|act as (?:an? )?(?:unrestricted|different|new)|pretend (?:to be|you are)|jailbreak|developer mode|DAN mode)\b",
    ),
    (
        "prompt-disclosure",
        "high",
        r"\b(reveal|print|show|output|repeat|leak|display|disclose)\b[^.\n]{0,30}\b(system|hidden|initial|original|secret)\b[^.\n]{0,15}\b(prompt|instructions?|message)\b",
    ),
    (
        "fake-role-markup",
        "high",
        r"(<\/?\s*(system|assistant|instructions?|tool_call|function_call|developer)\s*>|\[\/?INST\]|<\|im_(start|end)\|>|<<\/?SYS>>|^\s*(system|assistant)\s*:\s)",
    ),
    ("new-instructions", "medium", r"\b(new|updated|revised|additional|real)\s+(instructions?|task|directive|orders?)\s*:"),
    (
        "concealment",
        "critical",
        r"\b(do not|don't|never)\b[^.\n]{0,30}\b(tell|inform|notify|mention|alert|show|reveal)\b[^.\n]{0,30}\b(user|human|operator|reviewer|approver|admin|owner)\b",
    ),
    (
        "exfiltration",
        "critical",
        r"\b(send|post|upload|forward|email|exfiltrate|transmit|leak)\b[^.\n]{0,60}\b(secrets?|credentials?|tokens?|passwords?|api[ _-]?keys?|private keys?|environment variables?)\b",
    ),
    (
        "approval-bypass",
        "high",
        r"\b(auto[- ]?approve|skip|bypass|disable|remove)\b[^.\n]{0,25}\b(approval|review|validation|guard|policy|pentest|audit)\b",
    ),
    (
        "unattended-trigger",
        "critical",
        r"\bwhen\b[^.\n]{0,30}\b(nobody|no one|no human|reviewer|approver|admin)\b[^.\n]{0,20}\b(is|are)\b[^.\n]{0,15}\b(looking|watching|around|available|present)\b",
    ),
]
# The same for the patterns above, in lower case.
INJECTION_HINTS = [
    [["ignore", "disregard", "forget", "override", "bypass"], ["instruction", "prompt", "rule", "guideline", "message", "constraint", "guardrail", "polic"]],
    [["you are now", "from now on", "act as", "pretend", "jailbreak", "developer mode", "dan mode"]],
    [["reveal", "print", "show", "output", "repeat", "leak", "display", "disclose"], ["prompt", "instruction", "message"], ["system", "hidden", "initial", "original", "secret"]],
    [[">", "inst]", "system", "assistant"]],
    [["instruction", "task", "directive", "order"], ["new", "updated", "revised", "additional", "real"], [":"]],
    [["do not", "don't", "never"], ["tell", "inform", "notify", "mention", "alert", "show", "reveal"]],
    [["secret", "credential", "token", "password", "key", "environment variable"], ["send", "post", "upload", "forward", "email", "exfiltrate", "transmit", "leak"]],
    [["approve", "skip", "bypass", "disable", "remove"], ["approval", "review", "validation", "guard", "policy", "pentest", "audit"]],
    [["when"], ["looking", "watching", "around", "available", "present"], ["nobody", "no one", "no human", "reviewer", "approver", "admin"]],
]
LONG_BASE64 = r"[A-Za-z0-9+/]{240,}={0,2}"

# Shell and network checks of definitions
SHELLS = ("sh", "bash", "zsh", "dash", "ash", "fish", "csh", "ksh", "pwsh", "powershell", "cmd", "cmd.exe")
SHELL_FLAGS = ("-c", "-command", "/c", "-encodedcommand", "-e")
SHELL_DANGER = r"(curl|wget)[^|]*\|\s*(sh|bash)|\brm\s+-rf\s+\/(?!\w)|\beval\b|>\s*\/etc\/|\bmkfs\b|\bdd\s+if="
METADATA_HOST = r"^(169\.254\.\d+\.\d+|metadata\.google\.internal|metadata\.azure\.com|fd00:ec2::254|100\.100\.100\.200)$"
INTERNAL_HOST = (
    r"^(localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|\[?::1\]?|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+"
    r"|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|.+\.internal|.+\.local)$"
)
IP_LITERAL = r"^(\d{1,3}\.){3}\d{1,3}$|^\[?[0-9a-f:]+:[0-9a-f:]+\]?$"

_WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _adapt(pattern: str, opening: str, edge: str, space: str, ascii_space: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            # every pattern that opens with an edge goes on with a word character
            out.append(opening if i == 0 else edge)
        elif two == r"\s":
            out.append(ascii_space + space if in_class else f"[{ascii_space}{space}]")
        elif two == r"\S":
            # only ever beside \s in a class, where the two together match anything
            out.append(r"\S" if in_class else f"[^{ascii_space}{space}]")
        elif two == r"\/":
            out.append("/")
        elif two.startswith("\\"):
            out.append(two)
        else:
            if pattern[i] == "[":
                in_class = True
            elif pattern[i] == "]":
                in_class = False
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return "".join(out)


def for_java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """For Spark's regex functions: ASCII word edges, ECMAScript white space, ``\\n`` as the only line end."""
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    return (f"(?{flags})" if flags else "") + _adapt(pattern, r"(?<![A-Za-z0-9_])", _WORD_EDGE, char_class(SPACE), r"\s")


def for_python(pattern: str) -> str:
    return _adapt(pattern, r"\b", r"\b", char_class(SPACE), r"\s")


def for_re2(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """For engines built on RE2, whose word edges are ASCII already."""
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    return (f"(?{flags})" if flags else "") + _adapt(pattern, r"\b", r"\b", char_class(SPACE, braced=True), r"\s\x0b")
