"""What the host allows and what this process has used, for sizing a local session."""

from __future__ import annotations

import os


def memory_limit(root: str = "/sys/fs/cgroup") -> int | None:
    """Bytes that the control group may use (version 2, then version 1); None without a limit."""
    for name in ("memory.max", "memory/memory.limit_in_bytes"):
        try:
            with open(os.path.join(root, name), encoding="ascii") as f:
                text = f.read().strip()
        except OSError:
            continue
        n = int(text) if text.isdigit() else None
        return None if n is None or n >= 1 << 62 else n
    return None


def peak_memory(status: str = "/proc/self/status") -> int:
    """Most bytes of memory that the process has held; 0 where that isn't told."""
    try:
        with open(status, encoding="ascii", errors="replace") as f:
            return next((int(line.split()[1]) * 1024 for line in f if line.startswith("VmHWM:")), 0)
    except OSError:
        return 0
