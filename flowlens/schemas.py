"""Schemas of captures, decoded packets, rules and flow decisions."""

FRAMES = "source string, frame_no long, ts_sec long, ts_usec int, incl_len long, orig_len long, link_type int, data binary"
#: Frames of a capture, with the latest time in it so far, in microseconds.
CAPTURED = FRAMES + ", arrived long"

#: The TLS client hello as the extractor sees it; sizes and order as on the wire.
HELLO = "valid boolean, has_sni boolean, sni string, legacy_version int, negotiated_version int, ciphers array<int>, extensions array<int>, groups array<int>, ec_formats array<int>, sig_algs array<int>, alpn array<binary>"

SEGMENTS = "flow_id string, ord long, seq long, syn boolean, data binary"

#: The directional five-tuple; addresses also as numbers whose lowest byte is the first octet.
FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

# Application names in the order of their numbers.
APPS = ["Unknown", "HTTP", "HTTPS", "DNS", "TLS", "QUIC", "Google", "Facebook", "YouTube", "Twitter/X", "Instagram", "Netflix", "Amazon", "Microsoft", "Apple", "WhatsApp", "Telegram", "TikTok", "Spotify", "Zoom", "Discord", "GitHub", "Cloudflare"]

#: Caps of a flow's first flight.
FLIGHT_BYTES, FLIGHT_SEGMENTS = 16 * 1024, 64
#: Seconds without packets after which a flow ends.
IDLE_SECONDS = 300
