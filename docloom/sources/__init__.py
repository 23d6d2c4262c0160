"""Readers, text of pages and files, exports, and tables in the shared folder."""
