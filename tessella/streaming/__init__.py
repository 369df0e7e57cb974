"""The same cleaning and lookups over streams; an extension."""
