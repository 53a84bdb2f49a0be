"""Column expressions: everything here returns a ``Column`` and keeps Catalyst in charge."""
