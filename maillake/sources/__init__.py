"""Readers: mailbox files, stored tables, CSV/list files, driver-table mail views."""
