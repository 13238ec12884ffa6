"""Schema mapping: types, column matching, compatibility, applying a mapping."""
