"""Feature tables from files, a catalogue and generators; result tables; sinks."""
