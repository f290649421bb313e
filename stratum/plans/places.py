"""A user's vaults and archive folders, kept in a JSON file that the caller names."""

from __future__ import annotations

import json
import os

KINDS = ("repos", "source_paths")


class Places:
    """Lists of {path, label}; a path is kept once, as an absolute one. An unreadable file counts as empty."""

    def __init__(self, file: str):
        self.file = os.path.abspath(os.path.expanduser(file))

    def _load(self) -> dict:
        try:
            with open(self.file, encoding="utf-8") as f:
                data = json.load(f)
        except (OSError, ValueError):
            return {}
        return data if isinstance(data, dict) else {}

    def _save(self, data: dict) -> None:
        os.makedirs(os.path.dirname(self.file), exist_ok=True)
        with open(f"{self.file}.tmp", "w", encoding="utf-8") as f:
            json.dump(data, f, indent=2, ensure_ascii=False)
        os.replace(f"{self.file}.tmp", self.file)

    def list(self, kind: str) -> list[dict]:
        rows = self._load().get(kind, [])
        rows = rows if isinstance(rows, list) else []
        return [{"path": r["path"], "label": str(r.get("label") or "")} for r in rows if isinstance(r, dict) and isinstance(r.get("path"), str) and r["path"]]

    @staticmethod
    def _whole(path: str) -> str:
        return path if "://" in path else os.path.realpath(os.path.expanduser(path))

    def add(self, kind: str, path: str, label: str = "") -> bool:
        """Whether the path is new; a label given for a known path replaces its old one."""
        data, rows, whole = self._load(), self.list(kind), self._whole(path)
        known = next((r for r in rows if r["path"] == whole), None)
        if known is None:
            rows.append({"path": whole, "label": label})
        elif label:
            known["label"] = label
        self._save(data | {kind: rows})
        return known is None

    def remove(self, kind: str, path: str) -> bool:
        data, rows, whole = self._load(), self.list(kind), self._whole(path)
        left = [r for r in rows if r["path"] != whole]
        if len(left) < len(rows):
            self._save(data | {kind: left})
        return len(left) < len(rows)
