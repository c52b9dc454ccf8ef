"""Directory discovery on the driver, with ignore files; file bytes are read by the executors."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Folders and extensions that are never searched.
SKIPPED_DIRS = frozenset({"lost+found", ".git", "node_modules", "target", "__pycache__", ".tox", ".venv", "venv", ".lexgrain"})
SKIPPED_EXTENSIONS = frozenset({"so", "o", "dylib", "a", "dll", "exe", "pyc", "jpg", "png", "gif", "mp4", "mp3", "pdf", "zip", "7z", "rar", "sqlite", "db", "bin"})
IGNORE_FILES = (".gitignore", ".lexgrainignore")


@dataclass(frozen=True)
class Found:
    path: str  # relative to the root, with forward slashes
    ext: str
    mtime_ns: int
    size: int


def extension(name: str) -> str:
    stem, dot, ext = name.rpartition(".")
    return ext if dot and stem else ""


def _translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            if glob[i] == "\\" and i + 1 < len(glob):
                i += 1
            out, i = out + re.escape(glob[i]), i + 1
    return out


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    allow: bool
    dirs_only: bool
    base: str  # folder of the ignore file

    def decides(self, path: str, is_dir: bool) -> bool:
        if self.dirs_only and not is_dir or self.base and not path.startswith(self.base + "/"):
            return False
        return bool(self.pattern.fullmatch(path[len(self.base) + 1 if self.base else 0 :]))


def rules(text: str, base: str = "") -> list[Rule]:
    out = []
    for raw in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", raw)
        if not line or line.startswith("#"):
            continue
        allow = line.startswith("!")
        line = line[1:] if allow else line
        dirs_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = _translate(line.lstrip("/"))
        out.append(Rule(re.compile(body if anchored else f"(?:.*/)?{body}"), allow, dirs_only, base))
    return out


def ignored(path: str, is_dir: bool, stack: list[Rule]) -> bool:
    """The last rule that matches decides."""
    for rule in reversed(stack):
        if rule.decides(path, is_dir):
            return not rule.allow
    return False


def walk(root: str, warn=None, archives: bool = False, ignore_files: tuple[str, ...] = IGNORE_FILES) -> Iterator[Found]:
    """Files under root in sorted order. Hidden names are included; what can't be read is passed to warn and skipped."""
    warn = warn or (lambda path, error: None)
    if os.path.isfile(root):
        st = os.stat(root)
        yield Found(os.path.basename(root), extension(os.path.basename(root)), st.st_mtime_ns, st.st_size)
        return

    def below(folder: str, rel: str, stack: list[Rule]) -> Iterator[Found]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            warn(folder, e)
            return
        for name in ignore_files:
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    stack = stack + rules(f.read(), rel)
            except OSError:
                pass
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in SKIPPED_DIRS and not ignored(path, True, stack):
                        yield from below(e.path, path, stack)
                elif e.is_file(follow_symlinks=False) and not ignored(path, False, stack):
                    ext = extension(e.name)
                    packed = ext == "zip" or e.name.endswith(".tar.gz")
                    if packed and archives or not packed and ext not in SKIPPED_EXTENSIONS:
                        st = e.stat()
                        yield Found(path, ext, st.st_mtime_ns, st.st_size)
            except OSError as error:
                warn(e.path, error)

    yield from below(root, "", [])
