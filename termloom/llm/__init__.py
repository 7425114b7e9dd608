"""Operators for preparing training text at corpus scale; nothing else in termloom imports this subpackage."""
