"""Program search over a catalogue of text operators."""
