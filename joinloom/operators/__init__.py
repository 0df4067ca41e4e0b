"""The two operators of a plan: scan and inner equi-join."""
