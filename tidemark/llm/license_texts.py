"""Public license wording as templates, in the markup of the public license list.

<<beginOptional>>..<<endOptional>> may be left out. <<var;name=..;original=..;match=..>> stands for other words; match
is .+ (one word or more), .* (any number) or .{a,b} (a to b characters). <<var;words=a-b>> stands for a to b words.

*-license is a whole license, *-notice the whole notice that a license asks for, *-opening the first sentences of a
license, whose rest may have been changed, *-statement a line that names one.
"""


def _any(name: str, original: str) -> str:
    return f'<<var;name="{name}";original="{original}";match=".+">>'


_NUMBER = '<<var;name="bullet";original="{}";match=".{{0,20}}">>'
_MIT_OPENING = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files<<beginOptional>> (the "Software")<<endOptional>>,'
    " to deal in <<var;words=1-3>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
    " <<var;words=1-3>>, and to permit persons to whom <<var;words=1-3>> is furnished to do so, subject to the following conditions"
)
_ISC_OPENING = (
    "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,"
    " provided that the above copyright notice and this permission notice appear in all copies"
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
_BSD_CONDITIONS = (
    _BSD_START + _NUMBER.format("1.") + " " + _BSD_SOURCE + ". " + _NUMBER.format("2.") + " Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    _NUMBER.format("3.") + " Neither the name of " + _any("organizationClause3", "the copyright holder") + " nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY " + _any("copyrightHolderAsIs", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS") + ' "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT'
    " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL " + _any("copyrightHolderLiability", "THE COPYRIGHT HOLDER OR CONTRIBUTORS")
    + " BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"
    " LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE"
    " OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_PROGRAM = '<<var;name="program";original="This program";match=".{1,100}">>'


def _gnu_notice(kind: str) -> str:
    return (
        f"is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation,"
        f" either version <<var;words=1-2>> of the License, or (at your option) any later version. {_PROGRAM} is distributed in the hope that it will be useful, but WITHOUT ANY"
        f" WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details"
        f"<<beginOptional>>. You should have received a copy of the GNU {kind} along with <<var;words=1-4>><<beginOptional>>. If not, see <https://www.gnu.org/licenses/><<endOptional>><<endOptional>>"
    )


TEMPLATES = {
    "mit-license": (
        _MIT_OPENING + ": The above copyright notice and this permission notice<<beginOptional>> (including the next paragraph)<<endOptional>> shall be included in all copies or substantial"
        ' portions of <<var;words=1-3>>. <<var;words=1-3>> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL " + _any("copyrightHolderLiability", "THE AUTHORS OR COPYRIGHT HOLDERS")
        + " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH <<var;words=1-3>>"
        " OR THE USE OR OTHER DEALINGS IN <<var;words=1-3>>"
    ),
    "isc-license": (
        _ISC_OPENING + '. THE SOFTWARE IS PROVIDED "AS IS" AND ' + _any("copyrightHolderAsIs", "THE AUTHOR") + " DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
        " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL " + _any("copyrightHolderLiability", "THE AUTHOR") + " BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL"
        " DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
    ),
    "bsd-2-license": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-license": _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER,
    "zlib-license": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
        " restrictions: " + _NUMBER.format("1.") + " The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software"
        " in a product, an acknowledgment in the product documentation would be appreciated but is not required. " + _NUMBER.format("2.") + " Altered source versions must be plainly marked as"
        " such, and must not be misrepresented as being the original software. " + _NUMBER.format("3.") + " This notice may not be removed or altered from any source distribution"
    ),
    "apache-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;words=1-3>> except in compliance with the License. You may obtain a copy of the License at'
        " http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is"
        ' distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and'
        " limitations under the License"
    ),
    "gpl-notice": _gnu_notice("General Public License"),
    "lgpl-notice": _gnu_notice("Lesser General Public License"),
    "agpl-notice": _gnu_notice("Affero General Public License"),
    "cc-by-notice": (
        "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>Creative Commons Attribution <<var;words=1-2>> International License<<beginOptional>>. To view a copy"
        " of this license, visit http<<beginOptional>>s<<endOptional>>://creativecommons.org/licenses/by/<<var;words=1-2>><<endOptional>>"
    ),
    "mit-opening": _MIT_OPENING,
    "isc-opening": _ISC_OPENING,
    "bsd-opening": _BSD_START + _NUMBER.format("1.") + " " + _BSD_SOURCE,
    "gpl-opening": (
        "is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>>"
        " <<beginOptional>>Affero<<endOptional>> General Public License as published by the Free Software Foundation"
    ),
    "apache-statement": "Licensed under the Apache License, Version 2.0",
    "gpl-statement": "licensed under the GNU General Public License<<beginOptional>>, version <<var;words=1-2>><<endOptional>>",
    "mit-statement": "<<beginOptional>>Released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "cc-by-statement": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons Attribution<<endOptional>> CC BY<<beginOptional>>-<<var;words=0-2>><<endOptional>> 4.0",
}
