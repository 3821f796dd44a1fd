"""Pure Column functions; none of them needs a session."""
