"""Tables, entity catalogue input and the snapshot store."""
